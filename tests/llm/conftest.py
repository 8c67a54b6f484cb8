"""Small tables for the operators on training data."""

import datetime as dt

import pytest


@pytest.fixture(scope="session")
def ts():
    return lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=n)
