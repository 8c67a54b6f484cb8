"""Credentials in source code: found by lexing around credential-named identifiers, redacted without touching the code around them.

A cheap pattern finds the places where a name that means a credential is assigned, passed or announced; from there the code is lexed:
operators, brackets, string literals with their escapes, concatenations, block scalars. A literal is a credential unless it is a
placeholder, a mask, a reference (variable, vault, environment), a sentence, a plain word or an identifier. Key blocks, user info in
URLs, authorization headers, connection strings and tokens with a published prefix have their own forms. Values have no upper length;
under six characters (four in URLs) they are too short to open anything.

Defined cases: null and empty texts hold nothing; equal rows count once; lines are the pieces between line feeds; whole texts of any
length are read; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecall.operators.ordered import POS, split_ordered
from loomrecall.session import spread

MASK = "REDACTED"
#: From these lengths on, a value in one literal or put together from several is told from embedded data by what it holds.
LONG = 4096
LONG_JOINED = 512
_CORE = r"(?:pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|auth|credentials?|(?:api|access|signing|private|encrypt(?:ion)?|auth|master|account|shared|storage|service|hmac|subscription|license)[_-]?key)"
_STEMS = ("pass", "pwd", "secret", "token", "auth", "credential", "key")
#: From a credential word: the rest of its name, what closes the name, and the operator that gives it a value.
_NAMED = re.compile(r"([\w-]*)((?:\\?[\"'`]|\])*)[ \t]*(:=|=>|=(?![=>~])|:(?!:))[ \t]*")
_FLAG = re.compile(rf"(?i)--?(?:[a-z]+-)*{_CORE}(?:\\?[\"'])?(?:[ \t]*,[ \t]*|[ \t]+|=)(?:\\?[\"'])?([^\s\"',\\\]]+)")
_ENV = re.compile(rf"(?i)\b(?:ENV|ARG)[ \t]+[\w-]*{_CORE}[ \t]+(\S+)")
_NETRC = re.compile(r"(?i)\blogin[ \t]+\S+[ \t]+password[ \t]+(\S+)")
_SQL = re.compile(r"(?i)\b(?:password|identified[ \t]+by)[ \t]+(?:=[ \t]*)?'([^'\n]+)'")
_TAG = re.compile(rf"(?i)<(?:[\w.-]*{_CORE})(?:[ \t][^<>]*)?>([^<>\n]+)</")
_USER = re.compile(r"(?:-u|--user)[ \t=]+[\"']?[\w.@-]+:([^\s\"'@]+)")
#: Credentials told in prose or comments: "login for host: admin / ...", "root:...", "pw on host is ...".
_ROOT = re.compile(r"(?i)\b(?:root|admin|administrator)[ \t]*[:/][ \t]*(\S+)")
#: What parts a clause, a word that announces the value, and the value.
_LOGIN = re.compile(r"(?i)([\n;{}])|\b(log-?in|credentials?|user)\b|[:=][ \t]*[\w.@-]{2,}+[ \t]*/[ \t]*(\S+)")
_SAID = re.compile(r"(?i)([\n=:;\"'(){}])|\b(pw|pass|pwd|passwd|password|passphrase|secret|token)\b|\b(?:is|was|are)[ \t]+[\"'`]?(\S+)")
_URL = re.compile(r"://[^\s:/@'\"`<>]*+:(?=[^\s'\"`<>/@])")
_URL_END = re.compile(r"[^\s'\"`<>]*+")
_HEADER = re.compile(r"(?i)authorization[\"'\]]*[ \t]*[:=,][ \t]*[\"'`]?(?:bearer|basic|token|apikey|api-key)[ \t]+([^\s\"'`,;)}]+)")
#: Published prefixes of service tokens (fixed values).
_PREFIXED = re.compile(
    r"(?<![\w/+-])(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_\w{40,}|glpat-[\w-]{20}|xox[abeprs]-[\w-]{16,}|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{30,}|[sr]k_live_[A-Za-z0-9]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{36}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,})(?![\w])"
)
_KEY = re.compile(r"-----(BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_MARKS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AKIA", "ASIA", "AIza", "k_live_", "SG.", "npm_", "eyJ")
_COMMENT = re.compile(r"^[ \t]*(?:#|//|--|;|\*|/\*|<!--|rem\b|>)", re.I)
_OPEN = re.compile(r"[ \t]*(?:[(\[{][ \t]*\r?\n?[ \t]*|[>|][+-]?[ \t]*(?:\r?\n[ \t]*|[ \t]+)|\r?\n[ \t]+(?=[\"'`]))")
_STRING = re.compile(r"(?:[rbfuRBFU]{0,2}|@|\$)(\\?\"\"\"|'''|\\?[\"'`])")
#: After a bare value: the end of the line, or what makes an expression of it.
_NOTHING = re.compile(r"[ \t\r\f\v]*[,;]?[ \t\r\f\v]*(?=\n|\Z)")
_GOES_ON = re.compile(r"[ \t\r\f\v]*(?:[|&=+*/?<>(]|(?:as|in|or|and|if)\b)")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Last words that turn a credential name into something else.
_OTHER = frozenset("field fields name names length len re regex pattern limit count counts url uri path paths type types ref refs hash hashes digest file files dir ttl expiry expires expired index list policy prefix suffix header headers min max size id ids label hint prompt error errors required enabled reset form input column format kind mode status state manager provider service store handler helper util utils factory endpoint version rotation age days rules rule strength score public template example placeholder env var variable stream budget usage window ring pool cache ize ized izer izers ized or ors ority ored ors".split())
_CRED = frozenset("pass password passwd passphrase passcode passwort pwd secret secrets token tokens auth credential credentials key apikey".split())
_PLACE = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-{3,}|_{3,}|#{3,}|0+|1234567?8?9?0?|(?:.*[^a-z])?(?:change[ _-]?(?:me|it|this)|your|redacted|masked|removed|hidden|example|sample|dummy|placeholder|todo|tbd|fixme|replace|insert|secret[_-]?here|goes[_-]?here|none|null|nil|undefined|true|false|unset|empty|fake|foobar|deadbeef)(?:[^a-z].*)?)$"
)
_REF = re.compile(r"\$\{|\$\(|^\$|\{\{|^%[\w]+%$|^<[^<>]*>$|^\[[^\[\]]*\]$|^\{[^{}]*\}$|^(?:vault|secret|secrets|env|ssm|arn|sops|kv|op|file|aws|gcp|azure|keyring|base64)(?::|\+|/)|^(?:process|os|env|secrets|settings|config|self|this|ctx|req|request|opts|args|params|data|user|row)\.|^/[\w./-]+$|^\.{0,2}/|^https?://|\*{3,}|x{6,}|•|…|\.\.\.$|<%|%\(|^@|^&")
#: Heads of long credentials: DER in base64 or hex, JWT, service tokens, base64 of a JSON object; and of media, archives and programs in base64 or hex.
_HEAD = re.compile(r"(?:MII[A-Za-z0-9+/]|MIG[A-Za-z0-9+/]|MC[4o]CAQ|MH[cQ]CAQ|3082[0-9a-fA-F]{4}0201|eyJ|ewog|eyAi|b3BlbnNzaC1rZXkt|LS0tLS1CRUdJTi)[A-Za-z0-9+/=_.\-]*$")
_DATA = re.compile(r"data:|iVBORw0KGgo|R0lGOD|/9j/|UklGR|UEsDB|H4sI|JVBERi|PHN2Zy|PD94bW|PCFET0|PGh0bW|AAAA|d09GR|T2dnU|SUQz|Qk[0-3]|TVqQ|f0VMR|KLUv|Qlpo|N3q8|89504[eE]47|47494638|[fF]{2}[dD]8[fF]{2}|504[bB]0304|1[fF]8[bB]08")
#: Names that alone do not tell a credential from a piece of text.
_WEAK = frozenset(("token", "tokens"))
_ONE_ALPHABET = re.compile(r"[A-Za-z0-9+/_.~=\-]+")
_NAMELIKE = re.compile(r"^(?:[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*|[a-z]+(?:[_.\-/:][a-z]+)+|[A-Z]+(?:_[A-Z]+)+|[A-Z]?[a-z]+\.[A-Za-z.]+)$")


def _is_secret(v: str, bare: bool) -> bool:
    if len(v) < 6 or any(c.isspace() for c in v):
        return False
    if len(v) > LONG:
        return _long_secret(v)
    if _REF.search(v) or _PLACE.match(v):
        return False
    if _PREFIXED.match(v):
        return "EXAMPLE" not in v
    if v.isdigit() or re.fullmatch(r"[\d.,:/-]+", v):
        return False
    if re.search(r"[\[\]\\^]|\{\d+\}|\(\?", v) and not re.search(r"\d.*[A-Za-z]|[A-Za-z].*\d", re.sub(r"\[[^\]]*\]|\{\d+(,\d*)?\}", "", v)):
        return False  # a pattern, no value
    if re.fullmatch(r"[a-z]+(?:[ _.\-/:][a-z]+)*|[A-Z]+(?:[_-][A-Z]+)*", v):
        return False
    if len(set(v)) < 4:
        return False
    if bare:
        return not _NAMELIKE.match(v) and not re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[a-z]+\d", v)
    return not re.fullmatch(r"(?:[A-Z][a-z]{2,}){1,2}|[a-z]{2,}(?:[A-Z][a-z]{2,})+", v) or bool(re.search(r"\d", v))


def _long_secret(v: str, name: str = "") -> bool:
    """Whether a long value is key material or a token: a known head (DER, JWT, base64 of JSON), or one alphabet without a pattern; media and archives are data, and so is what has no head under a name that also means a piece of text."""
    v = re.sub(r"\\[nrt]", "", v)
    if _DATA.match(v):
        return False
    if _HEAD.match(v):
        return len(set(v)) >= 16
    if name.lower() in _WEAK or not _ONE_ALPHABET.fullmatch(v):
        return False
    counts = Counter(v)
    bits = -sum(n / len(v) * math.log2(n / len(v)) for n in counts.values())
    # Random hex has nearly 4 bits a character and random base64 nearly 6; a repeated piece comes again at once.
    return bits >= (3.8 if len(counts) <= 22 else 5.0) and len({v[i : i + 8] for i in range(len(v) - 7)}) > 0.9 * (len(v) - 7)


def _name_before(text: str, start: int) -> str:
    a = start
    while a > 0 and (text[a - 1].isalnum() or text[a - 1] in "_-"):
        a -= 1
    return text[a:start]


def _names_secret(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _OTHER:
        return False
    last = words[-1]
    if last in _CRED:
        return last != "key" or len(words) > 1
    return any(last.endswith(c) for c in ("password", "passwd", "secret", "apikey", "passphrase")) or (last == "key" and len(words) > 1)


def _literal(text: str, at: int) -> tuple[int, int, str] | None:
    """Content span and value of the string literal that starts at ``at``; a literal that is cut off ends with the line."""
    m = _STRING.match(text, at)
    if not m:
        return None
    quote, begin = m.group(1), m.end()
    i = begin
    while i < len(text):
        if text.startswith(quote, i):
            return begin, i, text[begin:i]
        if text[i] == "\n" and len(quote) <= 2 and "`" not in quote:
            break
        i += 2 if text[i] == "\\" and not quote.startswith("\\") else 1
    return begin, min(i, len(text)), text[begin : min(i, len(text))]


def _strong(v: str) -> bool:
    """Letters and digits mixed as in made-up values, not as in identifiers."""
    if not re.search(r"\d", v) or not re.search(r"[A-Za-z]", v) or re.fullmatch(r"[a-z]+\d|\d+[a-z]+|v?[\d.]+\w*", v):
        return False
    return bool(re.search(r"[!$%^&*+~?@#]", v) or re.search(r"[a-z]+[_-]\d{3,}", v) or re.search(r"[A-Za-z]\d+[A-Za-z]", v) or len(v) >= 16)


def _after(text: str, at: int, op: str, name: str) -> list[tuple[int, int]]:
    """Spans of the credential that is given at ``at``; several if it is put together from pieces."""
    opened = _OPEN.match(text, at)
    here = opened.end() if opened and opened.end() > at else at
    block = bool(opened) and text[at : opened.end()].lstrip()[:1] in (">", "|")
    lit = _literal(text, here)
    if lit:
        if opened and text[at : opened.end()].lstrip()[:1] in ("[", "{"):
            return []
        spans, value = [(lit[0], lit[1])], lit[2]
        at = lit[1] + len(_STRING.match(text, here).group(1))
        bracket = bool(opened) and "(" in text[text.rfind("\n", 0, here) + 1 : lit[0]] + opened.group()
        while m := re.compile(r"[ \t\r]*\n?[ \t]*(?:\+|\.|\\\r?\n|~|&)?[ \t\r]*\n?[ \t]*(?=[\"'])").match(text, at):
            more = _literal(text, m.end()) if m.end() > at or text[at : at + 1] in "\"'" else None
            if not more or (not re.search(r"[+.\\~&]", text[at : m.end()]) and here == at):
                break
            if not re.search(r"[+.\\~&]", text[at : m.end()]) and not bracket:
                break
            spans.append((more[0], more[1]))
            value += more[2]
            at = more[1] + 1
        held = _long_secret(value, name) if len(spans) > 1 and len(value) > LONG_JOINED else _is_secret(value, False)
        return spans if held else []
    if opened and not block:
        return []
    m = _BARE.match(text, here)
    if not m:
        return []
    value, end = m.group(), m.end()
    if op == "=" and text[here - 1 : here] in " \t" and not (_strong(value.rstrip(".,;")) and _NOTHING.match(text, end)):
        return []  # an expression of code
    rest = text[end : end + 2]
    if rest[:1] in ("(", "[", "{", "<") or (rest[:1] == "," and op != "="):
        return []
    if op in (":", ":=", "=>") and not block:
        if op != ":" or rest[:1] in (";", ",", ")", "}", "]", "'", '"', "`"):
            return []
        if _GOES_ON.match(text, end):
            return []
    value = value.rstrip(".,")
    return [(here, here + len(value))] if _is_secret(value, True) else []


def _announced(form: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Spans of the first value after an announcing word in each clause."""
    told = False
    for m in form.finditer(text):
        if m.lastindex == 3 and told:
            yield m.span(3)
        told = m.lastindex == 2 or (told and m.lastindex is None)


def _url_values(text: str) -> Iterator[tuple[int, int]]:
    """Spans between the colon and the at sign of the user info in URLs."""
    end = at = -1
    for m in _URL.finditer(text):
        a = m.end()
        if a >= end:
            end = _URL_END.match(text, a).end()
            at = -1
        if at < a:
            at = text.find("@", a, end)
            while at >= 0 and not re.match(r"[\w\[$]", text[at + 1 : at + 2]):
                at = text.find("@", at + 1, end)
            at = at if at >= 0 else len(text)
        if at < end:
            yield a, at


def find_spans(text: str) -> tuple[list[tuple[int, int]], bool, bool]:
    """Spans of credential values in order; whether a key block that began before ends here; whether one is open at the end."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: set[tuple[int, int]] = set()
    named = False
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            named = True
            m = _NAMED.match(text, at)
            if m and m.end() - at > len(stem) and _names_secret(name := _name_before(text, at) + m.group(1)):
                spans.update(_after(text, m.end(), m.group(3), name))
            at = low.find(stem, m.end(1) if m else at + len(stem))
    told = named or "pw" in low or "root" in low or "admin" in low or "login" in low
    if named:
        if "-" in text:
            for m in _FLAG.finditer(text) if "--" in text or " -p" in text else ():
                if _is_secret(m.group(1), False):
                    spans.add(m.span(1))
        for gate, form, bare in (("env ", _ENV, True), ("arg ", _ENV, True), ("login", _NETRC, False), ("password", _SQL, False), ("identified", _SQL, False), ("</", _TAG, False)):
            if gate in low:
                spans.update(m.span(1) for m in form.finditer(text) if _is_secret(m.group(1).strip(), bare))
        if "authorization" in low:
            spans.update(m.span(1) for m in _HEADER.finditer(text) if len(m.group(1)) >= 8 and _is_secret(m.group(1), False))
    if "-u " in text or "--user" in text:
        spans.update(m.span(1) for m in _USER.finditer(text) if _is_secret(m.group(1), False))
    if told:
        for a, b in [m.span(1) for m in _ROOT.finditer(text)] + [*_announced(_LOGIN, text), *_announced(_SAID, text)]:
            v = text[a:b].rstrip(".,;\"'`)")
            if _is_secret(v, True) and _strong(v):
                spans.add((a, a + len(v)))
    if "://" in text and "@" in text:
        for a, b in _url_values(text):
            v = text[a:b]
            if len(v) >= 4 and not _REF.search(v) and not _PLACE.match(v) and not re.fullmatch(r"[a-z]+|\d+", v):
                spans.add((a, b))
    for m in _PREFIXED.finditer(text) if any(p in text for p in _MARKS) else ():
        if _is_secret(m.group(), False):
            spans.add(m.span())
    open_at, ended = None, False
    for m in _KEY.finditer(text) if "PRIVATE KEY" in text else ():
        if m.group(1) == "BEGIN":
            open_at = m.end()
        elif open_at is None:
            if not ended and not spans_before_begin(text, m.start()):
                spans.add((0, m.start()))
                ended = True
        else:
            if len(re.findall(r"[A-Za-z0-9+/=]", re.sub(rf"\\[nr]|{MASK}", "", text[open_at : m.start()]))) >= 24:
                spans.add((open_at, m.start()))
            open_at = None
    still = open_at is not None and text.find(MASK, open_at) < 0 and not re.search(r"[^\sA-Za-z0-9+/=:,\-\\\"'.]", text[open_at:])
    if still:
        spans.add((open_at, len(text)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out, ended, still


def spans_before_begin(text: str, end: int) -> bool:
    """Whether what stands before an END line is no key body (then the line is only mentioned)."""
    body = re.sub(r"\\[nr]", "", text[:end]).split()
    return not body or MASK in body[-1] or not re.fullmatch(r"[\"'+,]*[A-Za-z0-9+/=]{8,}[\"'+,]*", body[-1])


_JOINT = re.compile(r"[\"'][ \t\r]*\n?[ \t]*(?:\+|\.|\\\r?\n|~|&)?[ \t\r]*\n?[ \t]*[\"']")


def starts(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Line numbers on which the values start: a key block at its BEGIN line, a concatenation at its first piece."""
    out = set()
    end = -1
    for a, b in spans:
        joined = 0 <= end < a and _JOINT.fullmatch(text, end, a)
        end = b
        if joined:
            continue
        m = list(_KEY.finditer(text, max(0, text.rfind("-----BEGIN ", 0, a)), a)) if a >= 5 and text.startswith("-----", a - 5) else []
        at = m[-1].start() if m and m[-1].end() == a else a
        out.add(text.count("\n", 0, at) + 1)
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the content of each span replaced; everything else, line feeds in key blocks included, stays."""
    parts, last = [], 0
    for a, b in spans:
        parts += [text[last:a], "\n".join(MASK if p.strip() else p for p in text[a:b].split("\n"))]
        last = b
    return "".join([*parts, text[last:]])


#: A chunk that ends between a credential name and its value, and a chunk that begins with a value.
_PENDING = re.compile(r"(?<![\w.-])([\w.-]+)(?:\\?[\"'`]|\])*[ \t]*(?::=|=>|=|:)[ \t]*(?:\(|[>|][+-]?)?\s*\Z")
_LEADING = re.compile(r"\s*(?:([\"'])([^\"'\n]{6,})\1|(\S{6,})(?=[ \t]*(?:\r?\n|\Z)))")
#: After the last value of a chunk that goes on in the next one: nothing, or a joint of a concatenation.
_JOINT_END = re.compile(r"\s*\Z|[\"'`]\s*(?:\+|\.|\\|~|&)\s*\Z")
#: At the start of a chunk: the rest of a value, with the quote that closes it or the end of the line.
_REST = re.compile(r"\s*[\"'`]?([\w+/=.~!@#$%^&*-]+)(?=[\"'`]|[ \t]*[,;)}\]]*[ \t]*(?:\r?\n|\Z))")
#: A chunk that is nothing but one more piece of a value.
_PIECE = re.compile(r"\s*[\"'`]?([\w+/=.~!@#$%^&*-]+)(?:[\"'`][ \t]*(?:\+|\.|\\|~|&))?\s*\Z")


def awaits_value(text: str) -> bool:
    """Whether the text ends with a credential-named assignment that has no value yet."""
    m = _PENDING.search(text, text.rfind("\n", 0, len(text.rstrip())) + 1)
    return bool(m and _names_secret(m.group(1)))


def leading_value(text: str) -> bool:
    """Whether the text begins with a literal that would be a credential after such an assignment."""
    m = _LEADING.match(text)
    return bool(m and (_is_secret(m.group(2), False) if m.group(2) else _is_secret(m.group(3), True) and _strong(m.group(3))))


def goes_on(text: str, spans: list[tuple[int, int]], still: bool) -> bool:
    """Whether the text ends inside its last credential value, which then goes on in the next chunk: in an open literal, or before a joint."""
    if not spans or still:
        return False
    a, b = spans[-1]
    opened = text[a - 1 : a] in ("'", '"', "`") and a > 0
    return opened and bool(_JOINT_END.match(text, b))


_BODY = re.compile(r"[\"']?[A-Za-z0-9+/=]{8,}(?:\\n)?[\"']?[+,\\]?|[+,\\]")


def key_body(text: str) -> bool:
    """Whether the text is nothing but lines of base64, as the middle of a key block is."""
    head = text[:200].split()
    if MASK in head:
        return False
    return bool(head) and all(_BODY.fullmatch(w) for w in head[:3]) and all(_BODY.fullmatch(w) for w in text.split()[:-1])


FIELDS = ("chunk_text", "search_text")


def scan(chunks: DataFrame, redacted: bool = False) -> DataFrame:
    """Per distinct chunk row: ids, per field the ``*_lines`` of credentials, and the state of key blocks at its borders; with the redacted texts on request."""
    source = spread(chunks.select("id", "file_record_id", "chunk_index", *FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(3).to_pylist(), batch.column(4).to_pylist()]
            lines: tuple[list, list] = ([], [])
            clean: tuple[list, list] = ([], [])
            opened, ended, inside, awaits, leads, goes, passes = [], [], [], [], [], [], []
            for one, two in zip(*texts, strict=True):
                known: tuple | None = None
                for k, t in enumerate((one, two)):
                    if t is None:
                        lines[k].append([])
                        clean[k].append(None)
                        continue
                    if k == 1 and known and t.startswith(one) and not t[len(one) : len(one) + 1].isalnum():
                        spans = known[0]  # the chunk followed by the words of its path
                        found = known[1]
                    else:
                        spans, e, s = find_spans(t)
                        found = starts(t, spans) if spans else []
                        if k == 0:
                            known = (spans, found, e, s)
                    lines[k].append(found)
                    clean[k].append(redact(t, spans) if redacted and spans else t)
                opened.append(bool(known and known[3]))
                ended.append(bool(known and known[2]))
                inside.append(bool(one) and key_body(one))
                awaits.append(bool(one) and awaits_value(one))
                leads.append(bool(one) and leading_value(one))
                goes.append(bool(known) and goes_on(one, known[0], known[3]))
                passes.append(bool(one) and bool(_PIECE.match(one)))
            big = pa.list_(pa.int64())
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(lines[0], big), pa.array(lines[1], big), pa.array(opened), pa.array(ended), pa.array(inside), pa.array(awaits), pa.array(leads), pa.array(goes), pa.array(passes)]
            names = ["id", "file_record_id", "chunk_index", "chunk_lines", "search_lines", "opened", "ended", "inside", "awaits", "leads", "goes", "passes"]
            if redacted:
                cols += [pa.array(clean[0], pa.string()), pa.array(clean[1], pa.string())]
                names += list(FIELDS)
            else:
                keep = [i for i in range(batch.num_rows) if lines[0][i] or lines[1][i] or opened[i] or inside[i] or awaits[i] or leads[i] or goes[i] or passes[i]]
                cols = [c.take(pa.array(keep, pa.int64())) for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id string, file_record_id string, chunk_index int, chunk_lines array<bigint>, search_lines array<bigint>, opened boolean, ended boolean, inside boolean, awaits boolean, leads boolean, goes boolean, passes boolean"
    return source.mapInArrow(run, schema + (", chunk_text string, search_text string" if redacted else ""))


def _after_start(rows: DataFrame, label: str) -> DataFrame:
    """(file_record_id, chunk_index, start, first): the rows (file_record_id, chunk_index, start), one per place, with the first start of their run of neighbouring places.

    Places are numbered by ``split_ordered``, so a file of any size is no single task.
    """
    at = ["file_record_id", "chunk_index"]
    one = rows.where("file_record_id is not null and chunk_index is not null").groupBy(*at).agg(F.max("start").alias("start"))
    placed = split_ordered(one, at[:1], at[1:], label).withColumn("run", F.col("chunk_index") - F.col(POS))
    first = placed.where("start").groupBy("file_record_id", "run").agg(F.min("chunk_index").alias("first"))
    return placed.join(first, ["file_record_id", "run"]).select(*at, "start", "first")


def border_ids(seen: DataFrame) -> DataFrame:
    """(id, within, given) of the scanned chunks that lie wholly inside a key block, or begin with the value of a name at the end of the chunk before."""
    at = ["file_record_id", "chunk_index"]
    held = _after_start(seen.where("opened or inside").select(*at, F.col("opened").alias("start")), "credential-blocks").where("chunk_index > first").select(*at)
    within = seen.where("inside").join(held, at, "left_semi").select("id", F.lit(True).alias("within"), F.lit(False).alias("given"))
    waiting = seen.where("awaits").select("file_record_id", (F.col("chunk_index") + 1).alias("chunk_index")).distinct()
    given = seen.where("leads").join(waiting, at, "left_semi").select("id", F.lit(False).alias("within"), F.lit(True).alias("given"))
    return within.unionByName(given).groupBy("id").agg(F.max("within").alias("within"), F.max("given").alias("given"))


def rest_places(seen: DataFrame, border: DataFrame) -> DataFrame:
    """(file_record_id, chunk_index) where the rest of a value stands that began in a chunk before, whatever the number of chunks between."""
    at = ["file_record_id", "chunk_index"]
    rows = seen.where("goes or passes").join(border.where("given").select("id", "given"), "id", "left")
    start = F.col("goes") | (F.col("passes") & F.coalesce("given", F.lit(False)))
    held = _after_start(rows.select(*at, start.alias("start")), "credential-pieces").where("chunk_index >= first")
    return held.select("file_record_id", (F.col("chunk_index") + 1).alias("chunk_index")).distinct()


def find_credentials(chunks: DataFrame) -> DataFrame:
    """Distinct (chunk_id, field_name, line_no).

    A value may be cut off from its name by the end of a chunk: the next chunk of the file then has it on line 1. A chunk that lies wholly inside a key block has no marker of its own: only chunks that open a block or look like key bodies are
    brought together by file for that, and a block reaches on as long as the chunks follow each other without a gap.
    """
    from loomrecall.session import materialize

    seen = materialize(scan(chunks), "credentials")
    own = seen.select(F.col("id").alias("chunk_id"), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array("chunk_lines", "search_lines"))).alias("field_name", "ls")).select("chunk_id", "field_name", F.explode("ls").alias("line_no"))
    within = border_ids(seen).select("id")
    middle = within.join(chunks.select("id", *[F.col(f).isNotNull().alias(f) for f in FIELDS]).distinct(), "id").select(
        F.col("id").alias("chunk_id"), F.explode(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in FIELDS]))).alias("field_name"), F.lit(1).cast("long").alias("line_no")
    )
    return own.unionByName(middle).distinct()


def border_spans(one: str, two: str | None, within: bool, given: bool, rest: bool = False) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans in ``chunk_text`` and ``search_text`` of what belongs to a key block or a name of the chunk before."""
    spans: tuple[list, list] = ([], [])
    if within and key_body(one):
        spans[0].append((0, len(one)))
        m = re.match(r"\s*" + r"\s+".join(map(re.escape, one.split())), two) if two else None
        if m:
            spans[1].append((0, m.end()))
        elif two:
            spans[1].extend(m.span() for w in {w for w in one.split() if len(w) >= 4} for m in re.finditer(re.escape(w), two))
    m = _LEADING.match(one) if given and leading_value(one) else None
    if m:
        k = 2 if m.group(2) else 3
        spans[0].append(m.span(k))
        if two:
            spans[1].extend(f.span() for f in re.finditer(re.escape(m.group(k)), two))
    m = _REST.match(one) if rest else None
    if m:
        spans[0].append(m.span(1))
        if two:
            f = re.search(re.escape(m.group(1)), two)
            spans[1].extend([f.span()] if f else [])
    return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact_credentials(chunks: DataFrame) -> DataFrame:
    """Every chunk row in which ``find_credentials`` finds something, with both fields redacted: id, chunk_text, search_text.

    Key bodies and values that only the chunks before give away, and the rest of a value that began there, are masked too: these few
    chunks are read again, with what they hold themselves.
    """
    from loomrecall.session import materialize

    holds = (F.size("chunk_lines") > 0) | (F.size("search_lines") > 0)
    seen = materialize(scan(chunks, redacted=True).where(holds | F.expr("opened or inside or awaits or leads or goes or passes")), "redacted")
    border = materialize(border_ids(seen), "redacted-borders")
    places = rest_places(seen, border)
    rest = chunks.select("id", "file_record_id", "chunk_index").join(places, ["file_record_id", "chunk_index"], "left_semi").select("id", F.lit(False).alias("within"), F.lit(False).alias("given"), F.lit(True).alias("rest"))
    border = materialize(border.withColumn("rest", F.lit(False)).unionByName(rest).groupBy("id").agg(*[F.max(c).alias(c) for c in ("within", "given", "rest")]), "redacted-again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            keep = []
            for i, (one, two, *flags) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                more = border_spans(one or "", two, *flags)
                spans = [_merged(find_spans(t)[0] + extra) if t else [] for t, extra in zip((one, two), more, strict=True)]
                if not any(spans):
                    continue
                keep.append(i)
                for column, t, at in zip(out, (one, two), spans, strict=True):
                    column.append(redact(t, at) if at else t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *[pa.array(c, pa.string()) for c in out]], names=["id", *FIELDS])

    again = chunks.select("id", *FIELDS).join(border, "id").mapInArrow(run, "id string, chunk_text string, search_text string")
    return seen.where(holds).join(border, "id", "left_anti").select("id", *FIELDS).unionByName(again)
