"""Documents that are template residue, filler, error pages or script notices instead of content.

Every document is reduced to its running text (code blocks, code spans and quotations removed, numbers and ids unified). Equal running
texts form one node. Nodes whose text certainly stands in place of a body are trusted, and their label is propagated through all links: pairs
of nodes whose word shingles have a Jaccard similarity of at least 0.8. Only links at a labelled node can carry a label, so each round looks
for the similar nodes of the newly labelled ones, until it finds no more; that gives the labelled part of the connected components.

Candidates of a round come from partitioned SimHash tables (blocks of the bits as keys, Hamming distance checked) and from an equi-join of
shingle prefixes against the least labelled node of each key; equal shingle sets need no check, all others are verified on the whole sets.
SimHashes alone would lose most links at 0.8, so when these rounds have ended, all labelled nodes are joined with the others on the prefixes: in any one
order of all shingles, two nodes similar at 0.8 share one among their first n / 5 + 1, and that join, rare shingles first, loses none. A last
exact check on the document itself keeps the label only where the document has that kind of text. Unfilled fields are told by each document alone.

Defined cases: null, empty and blank texts are no residue; equal texts share their result; whole texts of any length are read; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrecall.session import materialize, spread

SHINGLE = 5
SIMILARITY = 0.8
#: Documents that are read to tell frequent shingles from rare ones, the most shingles kept as frequent, and rows of a key that meet in one task.
SAMPLE = 5_000
FREQUENT = 100_000
CELL = 1_000
#: Bits in which SimHashes of candidates differ at most, and the blocks (first bit, bits) of which two make a key.
HAMMING = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code)\b.*?(?:</\1>|\Z)", re.S)
#: A line that is an error answer of a service.
_ANSWER = re.compile(r"^[ \t]*\{\s*\"(?:ok|success|error|errors|status|code|message|reason|detail|fault)\"\s*:.*\}[ \t]*$", re.M)
_SPAN = re.compile(r"`[^`\n]*`")
_QUOTE = re.compile(r"\"[^\"\n]{2,400}\"|“[^”\n]{2,400}”|«[^»\n]{2,400}»|„[^“”\n]{2,400}[“”]")
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ ._-][A-Za-z0-9]+){0,4}"
#: Spellings of a field that a template engine, or the author, should have filled.
FIELD = re.compile(
    rf"\{{\{{\s*[#/^&>-]?\s*{_NAME}(?:\s*\|[^{{}}\n]{{0,60}})?\s*\}}\}}|\{{%-?\s*{_NAME}\s*-?%\}}|\$\{{\s*{_NAME}\s*\}}|#\{{\s*{_NAME}\s*\}}|<%[=-]?\s*{_NAME}\s*-?%>"
    rf"|%\({_NAME}\)[sdrf]|(?<![\w%])%[A-Z][A-Z0-9_]{{2,}}%(?![\w%])|@@{_NAME}@@|\[\[\s*{_NAME}\s*\]\]|(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)"
    r"|\[(?:INSERT|ENTER|ADD|YOUR|FILL IN|TODO|TBD)\b[^\]\n]{0,60}\]|[\[<](?:insert|enter|add|your|fill in)[ _][^\]>\n]{1,60}[\]>]|<YOUR_[A-Z0-9_]+>"
    r"|[\[<][^\[\]<>\n]{1,40} (?:goes )?here[\]>]|(?<!\w)_{5,}(?!\w)|(?<![\w{$#%\\])\{[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*\}(?![\w}])",
)
_FIELD_SIGNS = ("{", "%", "@@", "[", "<", "__")
_STATUS = r"(?:bad request|unauthorized|payment required|forbidden|not found|method not allowed|gone|too many requests|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
#: Sentences that stand where a page failed; matched from the start of a sentence.
ERROR = re.compile(
    rf"(?:(?:http |error |fehler |erreur |status )?\d{{3}}[ :–-]+)?{_STATUS}[.!]?$|(?:http )?(?:error|fehler|erreur|código|status)(?: code)?:? ?\d{{3}}\b"
    r"|.{0,20}\b(?:can ?not|can't|could not|couldn't|unable to) find (?:the|that|this) page|(?:this|the|that) (?:page|record|document|site|view|link|file) (?:does not exist|doesn't exist|no longer exists|is down|could not be|cannot be|has been (?:moved|removed|deleted)|was not found|is not available|is (?:temporarily|currently) )"
    r"|page not found|no such (?:record|page|document|key|file)|access (?:is |was )?denied[.!,:]|access denied$|permission denied|(?:you|sie) do(?: not|n't) have (?:the )?(?:permission|access)|something went wrong|an? (?:unexpected |internal )?error (?:has )?occurred|oops\b"
    r"|(?:your|the) session (?:has )?(?:expired|timed out)[.!,]?|(?:please )?(?:sign|log) in (?:again|to continue|to view)|too many requests|(?:the )?upstream (?:did not|didn't|failed)|(?:this )?site is down|(?:please )?(?:try again|come back) (?:later|in )|retry after \d|we have been notified|it may have been (?:deleted|moved|removed)"
    r"|(?:fatal|uncaught|unhandled|php|segmentation)\b.{0,40}[:(]|warning: .*(?:failed|undefined|on line \d)|(?:please )?log in again|<\?xml|<error>|traceback \(most recent call last\)|(?:one moment|please wait|checking).{0,30}(?:verify|human|browser)|verify(?:ing)? (?:that )?you are (?:a )?human|the requested .{1,40} was not (?:delivered|found)|the server (?:could not|encountered|returned)|.*could not complete your request"
    r"|seite nicht gefunden|die (?:angeforderte|gewünschte) seite|zugriff verweigert|(?:bitte )?melden sie sich an|bitte (?:später|versuchen sie)|etwas ist schief"
    r"|(?:la )?page (?:demandée |)(?:est )?(?:introuvable|non trouvée)|.{0,20}la page demandée|accès refusé|veuillez (?:vous identifier|vous connecter|réessayer)|une erreur"
    r"|página no encontrada|(?:la )?página (?:solicitada|que busca)|acceso denegado|inicie sesión|es posible que el enlace|inténtelo|se ha producido un error|ha ocurrido un error",
    re.I,
)
_SCRIPT_WORD = re.compile(r"\b(?:java ?script|scripts|scripting|cookies|noscript|browser|navegador|navigateur)\b", re.I)
#: What a notice says about scripts.
SCRIPT = re.compile(
    r"\b(?:enable|enabled|disabled|requires?|required|needs?|turn(?:ed)? on|switch(?:ed)? on|switch .{0,12} on|allow|without|not supported|unsupported|benötigt|aktivieren|einschalten|ohne|activez|activer|sans|désactivé|habilite|active|necesita|requiere|sin|noscript|before opening)\b",
    re.I,
)
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua quis nunc nibh justo velit vel diam erat massa mauris orci porta purus quam tellus urna augue fusce donec enim nulla eget ante vitae".split())
_KEYS = frozenset("foo bar baz qux test blah asdf qwer qwerty jkl xxx xyz abc dummy sdf asd zxcv yxcv lala bla".split())
#: Sentences that stand for a text to come.
FILLER = re.compile(
    r"lorem ipsum|this is (?:a |an |some )?(?:sample|example|dummy|placeholder) (?:paragraph|text|sentence|page|heading)|(?:replace|change) (?:it|this|me) with your own|(?:example|sample) (?:heading|subheading|sentence|text|paragraph|title|content)\b|(?:body |your )?(?:text|copy|content|paragraph|description|title|headline|inhalt|caption)s? (?:goes|comes|will go|to go) here|(?:add|insert|write|put|type|enter|replace) (?:your|this|some)? ?(?:own )?(?:text|paragraph|content|copy|description)s?(?: here)?\b|(?:placeholder|dummy|sample|filler) (?:copy|text|content)\b"
    r"|(?:item|entry|element) \d+ [-–:] (?:description|text|content) of (?:item|entry|element) \d+|(?:\w+ ?\w*: ?)?(?:tbd|tba|todo|t\.b\.d\.|to be (?:written|defined|determined|done|added|announced|supplied))[.!]?$|coming soon|under construction|.{0,40}will be supplied later"
    r"|hier (?:steht|folgt|kommt) (?:später|noch|bald)|blindtext|platzhalter(?:text)?\b|texte? (?:provisoire|de remplissage|à venir|fictif)|faux[- ]texte|texto (?:de relleno|provisional|de ejemplo)|aquí va |(?:ici|votre) .{0,20}(?:texte|contenu) (?:ici|à venir)",
    re.I,
)
_FILL_WORDS = _LATIN | _KEYS
#: Parts of every word that _SCRIPT_WORD finds.
_SCRIPT_SIGNS = ("script", "cookies", "browser", "naveg", "navig")
_SIDE = re.compile(
    r"(?:#{1,6}\s.*|[-=_*~]{3,}|\(c\).*|©.*|(?:code|status)=\d+|ray [0-9a-f]+.*|[a-z]+/\d+(?:\.\d+)+|request id:.*|(?:trace|correlation|incident) id:.*|time: .*|skip to content|menu\b.*|loading\.*|(?:file|at) .*line \d+.*|\w*(?:error|exception)\b: .*)$",
    re.I,
)
_AFTER = re.compile(r"(?:go back to|return to|how to do this|reload\b|(?:please )?(?:reload|refresh|update)\b|if this keeps|if nothing appears|contact (?:the|your)|we use cookies|accept all|(?:please )?try again|update it or|bitte\b|please )", re.I)
_SPLIT = re.compile(r"(?<=[.!?。])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]+")


def running_text(text: str) -> str:
    """The text without code and quotations."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("​", "").replace("­", "").replace("﻿", "")
    return _QUOTE.sub(" ‹q› ", _ANSWER.sub("Error 500", _SPAN.sub(" ‹c› ", _FENCE.sub("\n‹c›\n", text))))


def unified_words(low: str) -> list[str]:
    """Words of a lower-case running text with numbers and ids unified."""
    return [w if w.isalpha() else "0" for w in _TOKEN.findall(low)]


def judge(text: str | None) -> tuple[list[str] | None, bool, bool, bool]:
    """Words of the running text with numbers and ids unified (null if blank); whether a field is unfilled; whether residue certainly stands in place of the body; whether the body is so short that it could be residue."""
    if not text or not text.strip():
        return None, False, False, False
    body = running_text(text)
    field = any(c in body for c in _FIELD_SIGNS) and bool(FIELD.search(body))
    low = body.lower()
    words = unified_words(low)
    fills = not _FILL_WORDS.isdisjoint(words)
    scripts = any(w in low for w in _SCRIPT_SIGNS)
    residue = content = lines = 0
    for line in body.split("\n"):
        line = line.strip()
        if not line:
            continue
        lines += 1
        if _SIDE.match(line) or (("|" in line or " > " in line or "  " in line) and not re.search(r"[.!?:]", line)):
            continue
        if lines <= 3 and not residue and not content and len(line.split()) <= 6 and not re.search(r"[.!?:;,\d]|‹", line) and not FILLER.match(line) and not ERROR.match(line) and not (fills and _fill_share(line)):
            continue  # a heading without a sign
        line = re.sub(r"^(?:[-*+>]|\d+[.)])\s+", "", line)
        for s in _SPLIT.split(line):
            s = s.strip(" \t*_")
            if s == "‹c›" or not _TOKEN.search(s):
                continue
            if (fills and _fill_share(s)) or FILLER.match(s) or ("‹" not in s and (ERROR.match(s) or (scripts and _SCRIPT_WORD.search(s) and SCRIPT.search(s)))):
                residue += 1
            elif not _SIDE.match(s) and not _AFTER.match(s):
                content += 1
            if content > 2:
                break
        if content > 2:
            break
    return words, field, bool(residue) and content <= 1, content <= 2


def _fill_share(s: str) -> bool:
    words = _TOKEN.findall(s.lower())
    if len(words) < 4:
        return False
    return sum(w in _LATIN for w in words) > 0.7 * len(words) or sum(w in _KEYS for w in words) > 0.7 * len(words)


_WORD_HASH: dict[str, int] = {}
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SHINGLE + 1)], np.uint64)


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the distinct runs of ``SHINGLE`` words (of all words, if there are fewer): sums of the words' hashes times a power of their place."""
    import xxhash

    if len(_WORD_HASH) > 500_000:
        _WORD_HASH.clear()
    for w in words:
        if w not in _WORD_HASH:
            _WORD_HASH[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(words))):
            out += h[k : k + n] * _POWERS[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each the majority of that bit over the hashes; as a signed integer."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    word = np.packbits(bits.sum(axis=0) * 2 > len(hashes)).tobytes()
    return int.from_bytes(word, "big", signed=True)


def prefix_size(n: int) -> int:
    """Shingles of a set of ``n`` among which every set with a Jaccard similarity of at least 0.8 has one, in any one order of all shingles."""
    return n // 5 + 1


def frequent_shingles(docs: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """The shingles that several documents of a sample share, the rarest first. Which they are decides on speed only: any order gives the same links."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(step)) == 0).select(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shingles(unified_words(running_text(t).lower())) for t in batch.column(0).to_pylist() if t and t.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.int64))], names=["gram"])

    counts = spread(some).mapInArrow(run, "gram bigint").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    return np.asarray(top.column("gram"), np.int64)[::-1].astype(np.uint64)


JUDGED = "node binary, field boolean, trusted boolean, short boolean, same binary, sim bigint, n int, prefix array<bigint>"


def judged_documents(docs: DataFrame, frequent: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with the key of its running text, its evidence, the key and size of its shingle set and the prefix of the set."""
    import hashlib

    by_value = np.argsort(frequent)
    sorted_frequent = frequent[by_value]

    def prefix(grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_frequent, grams)
        known = at < len(sorted_frequent)
        known[known] = sorted_frequent[at[known]] == grams[known]
        return np.concatenate([grams[~known], frequent[np.sort(by_value[at[known]])]])[: prefix_size(len(grams))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [doc_id, *[c.split()[0] for c in JUDGED.split(", ")]]
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            keep = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                words, field, trusted, short = judge(body)
                if words is None:
                    continue
                keep.append(i)
                grams = shingles(words)
                keys = [hashlib.blake2b(b, digest_size=16).digest() for b in (" ".join(words).encode(), grams.tobytes())]
                for column, v in zip(out, (keys[0], field, trusted, short, keys[1], simhash(grams), len(grams), prefix(grams).astype(np.int64)), strict=True):
                    column.append(v)
            kinds = (pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return spread(docs.select(doc_id, text)).mapInArrow(run, f"{doc_id} {kind}, {JUDGED}")


def _table_keys(sim: str = "sim"):
    """One key per pair of bit blocks."""
    block = [F.shiftrightunsigned(F.col(sim), 64 - a - n).bitwiseAND(F.lit((1 << n) - 1)) for a, n in BLOCKS]
    return F.array(*[(F.lit(t << 40) + block[i] * F.lit(1 << 13) + block[j]) for t, (i, j) in enumerate(itertools.combinations(range(len(BLOCKS)), 2))])


def print_candidates(front: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a labelled node and a node whose SimHashes lie within ``HAMMING`` bits. The tables hold distinct SimHashes, the least labelled node for each."""
    known = front.groupBy("sim").agg(F.min("node").alias("a"))
    a = known.select("a", F.col("sim").alias("sa"), F.explode(_table_keys()).alias("key"))
    b = nodes.select("sim").distinct().select(F.col("sim").alias("sb"), F.explode(_table_keys()).alias("key"))
    near = b.join(a, "key").where(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= HAMMING).groupBy("sb").agg(F.min("a").alias("a"))
    return nodes.select(F.col("node").alias("b"), F.col("sim").alias("sb")).join(near, "sb").select("a", "b")


def prefix_rows(nodes: DataFrame) -> DataFrame:
    """One row (key, node, n, pos) per node (node, n, prefix) and shingle of its prefix, with its place."""
    return nodes.select("node", "n", F.posexplode("prefix").alias("pos", "key"))


def star_candidates(front: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the least labelled node of each key with the nodes that may be similar to it: few, and enough for most."""
    least = prefix_rows(front).groupBy("key").agg(F.min(F.struct("n", "node", "pos")).alias("l"))
    both = prefix_rows(nodes).join(least, "key")
    # No more shingles than stand from here on can be shared, where this is the first shared one; a Jaccard similarity of 0.8 is 4/9 of both sizes.
    may = 9 * F.least(F.col("n") - F.col("pos"), F.col("l.n") - F.col("l.pos")) >= 4 * (F.col("n") + F.col("l.n"))
    return both.where(may).select(F.col("l.node").alias("a"), F.col("node").alias("b"))


def all_candidates(labelled: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs (a, b) of a labelled and an unlabelled node that share a key of their prefixes and may be similar.

    Rows of a hot key are cut into blocks and meet in cells of two blocks, so that no task holds all of its pairs.
    """
    known = prefix_rows(labelled)
    keys = known.groupBy("key").agg(F.count(F.lit(1)).alias("na"))
    # Copies of a text are one node, and labelled nodes look for others only.
    rows = prefix_rows(nodes).join(keys.select("key"), "key", "left_semi").distinct().join(labelled.select("node"), "node", "left_anti")
    blocks = F.ceil(F.greatest("na", "nb") / F.lit(CELL)).cast("long")
    cuts = keys.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("nb")), "key").select("key", blocks.alias("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    left = known.join(cuts, "key").select("key", F.explode(F.transform(every, lambda k: mine * F.col("blocks") + k)).alias("cell"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = rows.join(cuts, "key").select("key", F.explode(F.transform(every, lambda k: k * F.col("blocks") + mine)).alias("cell"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    near = (5 * F.col("na") >= 4 * F.col("nb")) & (5 * F.col("nb") >= 4 * F.col("na"))
    shared = left.join(right, ["key", "cell"]).where(near).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    # Of the node whose prefix ends first, only shingles behind the prefix can be shared besides the counted ones.
    rest = [F.col(n) - F.floor(F.col(n) / 5) - 1 for n in ("na", "nb")]
    return shared.where(9 * (F.col("shared") + F.greatest(*rest)) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def verified(links: DataFrame, grams: DataFrame) -> DataFrame:
    """The links (a, b) whose nodes share enough shingles; ``grams`` is (node, grams) of the nodes in question."""
    left, right = grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    held = links.join(left, "a").join(right, "b")
    return held.where(both >= F.lit(SIMILARITY) * (F.size("ga") + F.size("gb") - both)).select("a", "b")


def node_grams(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, grams) of the nodes in ``wanted`` (node, rep), from the text of one document each. Only linked nodes' texts are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(unified_words(running_text(t or "").lower())).astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["node", "grams"])

    texts = docs.select(F.col(doc_id).alias("rep"), F.col(text).alias("t"))
    one = wanted.join(texts, "rep").dropDuplicates(["node"])
    return one.select("node", "t").mapInArrow(run, "node binary, grams array<bigint>")


def reached_nodes(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node) of the trusted nodes and of all that links at ``SIMILARITY`` connect with them, over any number of other nodes."""
    fields = ["node", "same", "sim", "n", "prefix"]
    nodes = judged.select(*fields, F.col(doc_id).alias("rep"))
    one = [F.first(c).alias(c) for c in fields[1:]] + [F.min("rep").alias("rep")]
    front = materialize(judged.where("trusted").select(*fields, F.col(doc_id).alias("rep")).groupBy("node").agg(*one), "residue-front")
    labelled = front

    def found(near: DataFrame, label: str) -> DataFrame | None:
        """The nodes of verified candidate links (a, b) that are not labelled yet, or None."""
        done = labelled.select(F.col("node").alias("b"))
        near = materialize(near.where("a <> b").join(done, "b", "left_anti").distinct(), f"residue-near-{label}")
        if near.isEmpty():
            return None
        ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        linked = nodes.select("node", "rep").join(ends, "node").groupBy("node").agg(F.min("rep").alias("rep"))
        held = materialize(node_grams(docs, linked, doc_id, text), f"residue-grams-{label}")
        return verified(near, held).select(F.col("b").alias("node")).distinct()

    def twins(front: DataFrame) -> DataFrame:
        done = labelled.select("node")
        return nodes.select("node", "same").join(front.select("same").distinct(), "same", "left_semi").select("node").distinct().join(done, "node", "left_anti")

    def grow(new: DataFrame) -> DataFrame:
        return materialize(nodes.join(new, "node", "left_semi").groupBy("node").agg(*one), "residue-front")

    whole = False
    while not front.isEmpty():
        if whole:
            new = found(all_candidates(labelled, nodes), "all")
        else:
            new = found(print_candidates(front, nodes).unionByName(star_candidates(front, nodes)), "star")
            equal = twins(front)
            new = equal if new is None else new.unionByName(equal).distinct()
        front = materialize(labelled.limit(0), "residue-front") if new is None else grow(new)
        if front.isEmpty():
            if whole:
                break
            front, whole = labelled, True
            continue
        labelled, whole = labelled.unionByName(front), False
    return labelled.select("node")


def find_residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per residue document: ``doc_id``, ``kind`` (``field`` or ``body``) and whether the label came by a link (``propagated``)."""
    judged = materialize(judged_documents(docs, frequent_shingles(docs, doc_id, text), doc_id, text), "residue-docs")
    reached = reached_nodes(docs, judged, doc_id, text).withColumn("reached", F.lit(True))
    rows = judged.where("field or trusted or short").select(doc_id, "node", "field", "trusted", "short").join(reached, "node", "left")
    # The exact check: a field must be unfilled in this very text, and a body must be short enough to be replaced.
    kind = F.when(F.col("field"), "field").when(F.coalesce("reached", F.lit(False)) & (F.col("trusted") | F.col("short")), "body")
    return rows.select(doc_id, kind.alias("kind"), (~F.col("trusted") & ~F.col("field")).alias("propagated")).where("kind is not null")
