"""Personal data: fixed formats, and more of them by bootstrapping from the contexts in which these stand.

One pass over the texts finds the base spans (the seeds) and other tokens, or runs of tokens, with digits or @, and notes
the words around each: its lexical patterns (one or two words before, the second word before, one on either side, one or
two after).  A pattern that enough seeds share is counted over the whole corpus, whatever it surrounds.  Then confidence
flows on the graph of patterns and instances: a pattern is as good as the seeds and trusted instances that it surrounds,
out of all its occurrences; an instance as good as its patterns together, and it needs one that looks to the left.
Trusted instances are seeds of the next round, where they bring in patterns of their own, until nothing is added.  Last,
a word without digits counts, too, if trusted patterns enclose it from both sides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, _LOWER, flat, lean, materialize, mix64, prefix_hash, ship_code, span_hash, text_chunks, valid_text, words_of

KINDS = ("email", "ip", "card", "phone")
#: Distinct instances that a pattern needs, and the confidence from which it counts.
MIN_SUPPORT, MIN_CONFIDENCE = 3, 0.5
#: Confidence from which an instance is trusted, and a word without digits.
ACCEPT, ACCEPT_WORD = 0.8, 0.95
#: Added to a pattern's occurrences: few ones prove little.
SMOOTHING = 1.0
#: Bits of the filter that tells tasks which patterns to count (8 MB); more patterns make it let more others through,
#: which the join behind it takes out.
FILTER_BITS = 1 << 26
#: Patterns whose counts a task holds (16 MB) before it hands them on.
HELD = 1 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[0-9]")
_CUE = re.compile(r"[0-9@]")
_EDGE = "\"'()[]{}<>,;:.!?"


def emails(text: str) -> list[tuple[int, int]]:
    """Spans around each @: the whole run of local characters before it, and a domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda d: len(d.lstrip("0")) <= 3 and int(d.lstrip("0") or "0") <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m.groups()))]


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:  # 19 digits and the separators between them are at most 37
            digits = re.sub(r"[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        end = at + 1
        if (m := _PHONE.match(text, at)) and m.end() - at >= 4:
            end = m.end()
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(m.span())
        at = text.find("+", end)
    return out


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed formats, by kind and then start, in code points."""
    if _CUE.search(text) is None:
        return []
    return [(kind, s, e) for kind, find in FINDERS.items() for s, e in find(text)]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or @ that no base span touches, neighbours as one; of five characters or more.

    Edge punctuation is not part of a span.
    """
    out: list[tuple[int, int]] = []
    free, run_end = 0, -1
    busy = sorted((s, e) for _, s, e in taken)
    k = 0
    for m in _CUE.finditer(text):
        if m.start() < free:
            continue
        start, end = m.start(), m.end()
        while start > 0 and text[start - 1] not in BLANKS:
            start -= 1
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        free = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        # spans of one kind don't overlap, so all that end before a token have few behind them that reach into it
        while k < len(busy) and busy[k][1] <= start:
            k += 1
        hit, j = False, k
        while j < len(busy) and busy[j][0] < end:
            hit |= busy[j][1] > start
            j += 1
        if hit:
            run_end = -1
        elif run_end >= 0 and not text[run_end:start].strip(" ") and "\n" not in text[run_end:start]:
            out[-1] = (out[-1][0], end)
            run_end = end
        else:
            out.append((start, end))
            run_end = end
    return [(s, e) for s, e in out if e - s >= 5]


_FOLD = _LOWER.copy()
_FOLD[48:58] = 48
_NONE = np.uint64(0x5EED)
_C = np.array([0xD6E8FEB86659FD93, 0xA3B195354A39B70D], np.uint64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, end) of each word, and hashes of the words one and two before it, one and two after it, in its row."""
    low = _FOLD[data]
    start, end, row = words_of(low, offsets)
    h = span_hash(prefix_hash(low), start, end)
    around = []
    for step in (-1, -2, 1, 2):
        other = np.full(len(h), _NONE)
        here, there = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        same = row[here] == row[there]
        other[here][same] = h[there][same]
        around.append(other)
    return start, end, around


def _patterns(before: np.ndarray, before2: np.ndarray, after: np.ndarray, after2: np.ndarray) -> np.ndarray:
    """Six hashes a place, those of patterns that look to the left even, those that look to the right only odd."""
    with np.errstate(over="ignore"):
        left = [before * _C[0] + np.uint64(2), before * _C[0] + before2 * _C[1] + np.uint64(4), before2 * _C[0] + np.uint64(6), before * _C[0] + after * _C[1] + np.uint64(8)]
        right = [after * _C[0] + np.uint64(10), after * _C[0] + after2 * _C[1] + np.uint64(12)]
    return np.stack([*(mix64(x) & ~np.uint64(1) for x in left), *(mix64(x) | np.uint64(1) for x in right)]).view(np.int64)


_MENTION = pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("stop", pa.int32()), ("i", pa.int64()), ("p", pa.list_(pa.int64()))])
_FOUND = "uid long, doc_id long, h binary, mentions array<struct<kind:tinyint,start:int,stop:int,i:long,p:array<long>>>"


def _instance(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _mentions(text: str) -> list[dict]:
    """Base spans (kind 0 to 3) and candidates (kind -1) with instance and pattern hashes."""
    base = base_spans(text)
    spans = sorted([(s, e, KINDS.index(k)) for k, s, e in base] + [(s, e, -1) for s, e in candidates(text, base)])
    if not spans:
        return []
    data, offsets = flat(pa.array([text]))
    _, ends, (before, before2, after, after2) = _words(data, offsets - offsets[0])
    byte, char, places = 0, 0, []
    for s, e, _ in spans:
        byte += len(text[char:s].encode("utf-8", "surrogatepass"))
        char = s
        places.append((byte, byte + len(text[s:e].encode("utf-8", "surrogatepass")) - 1))
    first, last = np.searchsorted(ends, np.array(places).T, "right")  # the words that hold the span's first and last byte
    p = _patterns(before[first], before2[first], after[last], after2[last]).T.tolist()
    out = [{"kind": kind, "start": s, "stop": e, "i": _instance(text[s:e]), "p": x} for (s, e, kind), x in zip(spans, p, strict=True)]
    return sorted(out, key=lambda x: (x["kind"], x["start"]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uid = TaskContext.get().partitionId() << 36
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cut = batch.slice(at, 512)
            rows = [_mentions(t) if t and _CUE.search(t) else [] for t in cut.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + len(rows)), pa.int64()), cut.column("doc_id"), cut.column("h"), pa.array(rows, pa.list_(_MENTION))], names=["uid", "doc_id", "h", "mentions"])
            uid += len(rows)


def _filter(patterns: DataFrame) -> np.ndarray:
    """FILTER_BITS bits: those of the patterns are set, two for each."""
    bit = lambda x: x.bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = patterns.select(F.explode(F.array(bit(F.col("p")), bit(F.shiftright("p", 32)))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("x"))  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return out.view(np.uint64)


def _among(p: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each pattern may be one of the filter's."""
    p = p.view(np.uint64)
    out = np.ones(p.shape, bool)
    for b in (p & np.uint64(FILTER_BITS - 1), (p >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
        out &= (bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of each pattern as one."""
    p, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.zeros(len(p), np.int64)
    np.add.at(n, at, np.concatenate([x for _, x in parts]))
    return p, n


def _count(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(p, n): how often each pattern of the filter occurs around a word, whatever the word is.

    A task sums its counts, and hands them on when they are more than HELD patterns and at its end.
    """
    held, fresh, loose = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["p", "n"])
    for _, data, offsets in text_chunks(batches):
        for p in _patterns(*_words(data, offsets)[2]):
            fresh.append(np.unique(p[_among(p, bits)], return_counts=True))
            loose += len(fresh[-1][0])
        if loose >= max(HELD // 4, len(held[0])):
            held, fresh, loose = _summed([held, *fresh]), [], 0
        if len(held[0]) >= HELD:
            yield batch(held)
            held = (held[0][:0], held[1][:0])
    yield batch(_summed([held, *fresh]))


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, total) of the patterns over the whole corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(patterns))
    counted = docs.select("text").mapInArrow(lean(lambda it: _count(it, shared.value)), "p long, n long").groupBy("p").agg(F.sum("n").alias("total"))
    return materialize(counted.join(patterns, "p", "left_semi"), "totals")


def _or(conf: Column) -> Column:
    return 1 - F.exp(F.sum(F.log(1 - conf)))


def _score(links: DataFrame, instances: DataFrame, totals: DataFrame) -> DataFrame:
    """(p, kind, conf) of the patterns that count."""
    scored = links.join(instances, "i").groupBy("p", "kind").agg(F.sum(F.col("n") * F.col("c")).alias("s"), F.count("*").alias("k")).where(F.col("k") >= MIN_SUPPORT)
    conf = F.least(F.lit(0.99), F.col("s") / (F.greatest(F.col("total"), F.col("s")) + SMOOTHING))
    return scored.join(totals, "p").select("p", "kind", conf.alias("conf")).where(F.col("conf") >= MIN_CONFIDENCE)


def discover(found: DataFrame, docs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(i, kind) of the instances, not seeds, that the pattern graph trusts; (p, kind, conf) of its patterns.

    None where there are none.  Trust only grows with the instances, so the rounds end.
    """
    m = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = materialize(m.select("kind", "i", F.explode(F.array_distinct("p")).alias("p")).groupBy("kind", "i", "p").agg(F.count("*").alias("n")), "graph")
    links = edges.groupBy("i", "p").agg(F.sum("n").alias("n"))
    certain = edges.where("kind >= 0").select("i", "kind").distinct().withColumn("c", F.lit(1.0))
    instances, trusted, totals, known = certain, None, None, 0
    while True:
        reached = links.join(instances.select("i", "kind"), "i").groupBy("p", "kind").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SUPPORT)
        fresh = reached.select("p").distinct()
        fresh = materialize(fresh if totals is None else fresh.join(totals, "p", "left_anti"), "patterns")
        more = not fresh.isEmpty()
        if more:
            now = _occurrences(docs, fresh)
            totals = now if totals is None else totals.unionByName(now)
        if totals is None:
            return None, None
        patterns = materialize(_score(links, instances, totals), "scores")
        left = F.max(F.when(F.col("p") % 2 == 0, F.col("conf")))
        good = links.join(patterns, "p").groupBy("i", "kind").agg(_or(F.col("conf")).alias("c"), left.alias("left")).where(F.col("left").isNotNull() & (F.col("c") >= ACCEPT)).drop("left")
        trusted = materialize(good.join(certain.select("i").distinct(), "i", "left_anti"), "instances")
        n = trusted.count()
        if n == known:
            break
        known, instances = n, certain.unionByName(trusted)
    best = trusted.groupBy("i").agg(F.max(F.struct("c", (-F.col("kind")).alias("k"))).alias("b"))
    return (best.select("i", (-F.col("b.k")).cast("tinyint").alias("kind")) if known else None), patterns


def _enclosed(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h, start, stop, p): words without digits between patterns of the filter, and these."""
    for cut, data, offsets in text_chunks(batches):
        starts, ends, around = _words(data, offsets)
        p = _patterns(*around)
        hit = _among(p, bits)
        at = np.flatnonzero(hit[:4].any(0) & hit[4:].any(0))
        rows, hs, out = np.searchsorted(offsets, starts[at], "right") - 1, cut.column("h").to_pylist(), []
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])  # code points before each byte
        for j, row, start in zip(at.tolist(), rows.tolist(), (points[starts[at]] - points[offsets[rows]]).tolist(), strict=True):
            word = data[starts[j] : ends[j]].tobytes().decode("utf-8", "ignore")
            bare = word.strip(_EDGE)
            if len(bare) >= 3 and not _CUE.search(bare):
                start += len(word) - len(word.lstrip(_EDGE))
                out += [(hs[row], start, start + len(bare), x) for x in p[hit[:, j], j].tolist()]
        cols = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["h", "start", "stop", "p"])


def _words_between(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(h, words): by the hash of a text, the spans without digits that trusted patterns enclose from both sides."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(patterns.select("p")))
    places = docs.select("h", "text").mapInArrow(lean(lambda it: _enclosed(it, shared.value)), "h binary, start int, stop int, p long").distinct()
    side = lambda k: F.coalesce(_or(F.when(F.pmod(F.col("p"), F.lit(2)) == k, F.col("conf"))), F.lit(0.0))
    both = places.join(patterns, "p").groupBy("h", "start", "stop", "kind").agg(side(0).alias("l"), side(1).alias("r"))
    sure = both.where((F.col("l") >= MIN_CONFIDENCE) & (F.col("r") >= MIN_CONFIDENCE) & (1 - (1 - F.col("l")) * (1 - F.col("r")) >= ACCEPT_WORD))
    one = sure.groupBy("h", "start", "stop").agg(F.max(F.struct((F.col("l") + F.col("r")).alias("c"), (-F.col("kind")).alias("k"))).alias("b"))
    return one.groupBy("h").agg(F.collect_set(F.struct((-F.col("b.k")).cast("tinyint").alias("kind"), "start", "stop")).alias("words"))


def spans(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): base spans and discovered spans.

    Returns uid (a number of the row), doc_id, base and more (arrays of (kind, start, stop), kind an index of KINDS,
    offsets in code points, by kind and then start).  Null and empty texts have none; bytes that are no UTF-8 read as
    U+FFFD; texts are read whole, however long; a row without doc_id is searched like any other; repeated rows have a
    result each (an instance that occurs in several rows is one node of the graph); equal confidences go to the kind
    listed first; empty tables give no rows; other columns are ignored.
    """
    return _spans(docs).drop("h")


def _key(text: Column) -> Column:
    """128 bits that stand for a text: two of 1e10 texts are alike by chance once in 1e19 corpora."""
    return F.unhex(F.md5(text))


def _spans(docs: DataFrame) -> DataFrame:
    """``spans`` with ``h``, the key of the text."""
    ship_code(docs.sparkSession)
    text = valid_text()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _key(text).alias("h"))
    found = materialize(base.mapInArrow(lean(_find), _FOUND), "mentions")
    trusted, patterns = discover(found, base)
    seeds = F.transform(F.filter("mentions", lambda x: x["kind"] >= 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    none = F.array().cast("array<struct<kind:tinyint,start:int,stop:int>>")
    out = found.select("uid", "doc_id", "h", seeds.alias("base"), none.alias("more"))
    if trusted is not None:
        cand = found.select("uid", F.explode(F.filter("mentions", lambda x: x["kind"] < 0)).alias("m")).select("uid", "m.start", "m.stop", "m.i")
        hits = cand.join(trusted, "i").groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("hits"))
        out = out.join(hits, "uid", "left").withColumn("more", F.coalesce("hits", "more")).drop("hits")
    if patterns is not None and not patterns.where("p % 2 <> 0").isEmpty():
        words = _words_between(base, patterns)
        out = out.join(words, "h", "left").withColumn("more", F.concat("more", F.coalesce("words", none))).drop("words")
    return out.select("uid", "doc_id", "h", "base", F.array_sort("more").alias("more"))


def mask(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of ``spans`` replaced by its kind in angle brackets; other columns stay.

    A row's spans are those of its own text, found by a key of 128 bits of the text, so repeated rows are masked alike.  Null
    texts stay null, empty ones empty; bytes that are no UTF-8 become U+FFFD; texts are masked whole, however long; of
    overlapping spans the one that starts first gives the mark; empty tables give no rows.
    """
    keyed = docs.withColumn("text", valid_text()).withColumn("__h", _key(F.col("text")))
    of = _spans(docs.select("doc_id", "text"))
    hit = of.select(F.col("h").alias("__h"), F.concat("base", "more").alias("__s")).where(F.size("__s") > 0)
    one = hit.groupBy("__h").agg(F.max("__s").alias("__s"))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_masked(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("__s").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names], names=names)

    schema = docs.schema
    return keyed.join(one, "__h", "left").select(*names, "__s").mapInArrow(lean(run), schema)


def _masked(text: str | None, found: list[dict] | None) -> str | None:
    if not found or text is None:
        return text
    out, at = [], 0
    for s in sorted(found, key=lambda x: (x["start"], -x["stop"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])
