"""Markers anywhere in the run of comments at the head or end."""

from loomrecall.llm import handwritten as H

NOTE = [f"// Line {c} of our own notes on how this is used." for c in "abcdefghij"]
MARK = "// Code generated by protoc-gen-go. DO NOT EDIT."


def test_whole_comment_run_is_read():
    assert H.told("\n".join([*NOTE, MARK, "package x", "var a = 1"]), True)[0]
    assert H.told("\n".join(["var a = 1", MARK, *NOTE]), False)[0]
    assert H.told("\n".join(["#!/bin/x", "package x", "/* ours", "by us", "*/", MARK]), True) == (True, False, True)
    assert not H.told("\n".join(["var b = 2", *NOTE, MARK, "var a = 1"]), True)[0]
