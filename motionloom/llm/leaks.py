"""Evaluation passages in training texts.

Method: the words of each shard of the corpus are indexed once (FM-index); the short word
phrases of all test items are found by backward search and located by sampled positions.
A document with several rare phrases of an item, or with as many of its phrases, rare or not,
on close diagonals as one of two passages must leave whole, is aligned with that item word by
word, which forgives changed, missing and added words. Spans are merged twice: over the words of
the item, to tell how much of it leaked, and over the document, to tell what to remove.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionloom.functions.labels import translation
from motionloom.llm.fmindex import FMIndex
from motionloom.runtime import cut, spread

SHARD_WORDS = 400_000
PART_WORDS = 200_000
PART_OVERLAP = 1_000
ITEM_BLOCK = 2_000
BLOCK_WORDS = 400_000
PASS_BLOCKS = 8
HITS = 1_000_000

_BROKEN = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h\d|hr|pre|blockquote|section)\b[^<>]{0,300}>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_HYPHEN_BREAK = re.compile(r"(?<=\w)[-‐­]\s*\r?\n\s*(?:>\s*)*(?=[a-z])")
_APOSTROPHE = re.compile(r"[‘’ʼ´`'′＇]")
_UNSEEN = regex.compile(r"[\p{Mn}\p{Cf}]+")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = str.maketrans(*translation())


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


def words_of(text: str) -> list[str]:
    """Plain words of a text: markup, entities, wrong encodings, accents, invisible characters, case and breaks resolved."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if not text.isascii():
        text = _BROKEN.sub(_repair, text)
        text = unicodedata.normalize("NFKD", text)
        text = _UNSEEN.sub("", text)
    text = _APOSTROPHE.sub("", _HYPHEN_BREAK.sub("", text)).lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    return _WORD.findall(text)


def _hashes(words: list[str]) -> list[int]:
    """A hash of every beginning of a word list: one for its first word, one for its first two, and so on."""
    out, h = [], 0
    for w in words:
        # Sums of characters by place: the same in every process, unlike hash().
        h = (h * 1_000_003 + zlib.crc32(w.encode()) + 1) % ((1 << 61) - 1)
        out.append(h)
    return out


def prepared_items(bench: DataFrame, item_id: str = "item_id", item_text: str = "text", k: int = 3, rare: int = 3, shared: int = 4) -> DataFrame:
    """key, item, words, own_from, own_to, phrases, others of every test item, counted over all items.

    own_from and own_to: its first and last word that isn't part of a standing instruction or closing
    question, that is of a beginning or end of four words or more that ``shared`` items have. phrases:
    where those phrases of ``k`` words begin that at most ``rare`` items have; all its phrases where it
    has none such. others: where all its other phrases begin. Rows without id or text are left out; equal rows are one item.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [words_of(t) for t in pdf["t"]]
            yield pd.DataFrame(
                {"key": pdf["key"], "item": pdf["i"], "words": words, "heads": [_hashes(w) for w in words], "tails": [_hashes(w[::-1]) for w in words]}
            )

    rows = bench.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null").distinct()
    items = cut(rows.withColumn("key", F.xxhash64("i", "t")).mapInPandas(split, "key long, item long, words array<string>, heads array<long>, tails array<long>"))

    ends = None
    for side in ("heads", "tails"):
        some = items.select("key", F.lit(side).alias("side"), F.posexplode(side).alias("size", "hash")).where("size >= 3")
        ends = some if ends is None else ends.unionByName(some)
    standing = ends.groupBy("side", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared).drop("n")
    longest = ends.join(standing, ["side", "hash"]).groupBy("key").agg(*[F.max(F.when(F.col("side") == s, F.col("size") + 1)).alias(n) for s, n in (("heads", "lead"), ("tails", "tail"))])

    size = F.size("words")
    width = F.least(F.lit(k), size)
    at = F.when(size > 0, F.sequence(F.lit(0), size - width))
    phrase = items.select("key", F.posexplode(F.transform(at, lambda x: F.concat_ws(" ", F.slice("words", x + 1, width)))).alias("at", "phrase"))
    where = phrase.groupBy("phrase", "key").agg(F.collect_list("at").alias("at"))
    kept = where.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rare).select("phrase")
    own = where.join(kept, "phrase").groupBy("key").agg(F.flatten(F.collect_list("at")).alias("phrases"))

    lead, tail = F.coalesce("lead", F.lit(0)), F.coalesce("tail", F.lit(0))
    # Where whole items are copies of one another, nothing is left; then all of it counts.
    some = lead + tail < size
    every = F.coalesce(at, F.array().cast("array<int>"))
    return (
        items.join(longest, "key", "left")
        .join(own, "key", "left")
        .select(
            "key",
            "item",
            "words",
            F.when(some, lead).otherwise(0).alias("own_from"),
            F.when(some, size - tail - 1).otherwise(size - 1).alias("own_to"),
            F.coalesce(F.array_sort("phrases"), every).alias("phrases"),
            F.when(F.col("phrases").isNull(), F.array().cast("array<int>")).otherwise(F.array_except(every, "phrases")).alias("others"),
        )
    )


def _whole(p: int, k: int = 3, every: int = 6) -> int:
    """How many phrases of ``k`` words a passage of ``p`` words leaves whole, wherever a sixth of them are changed, missing or have one added.

    More than a sixth, and ``leaks`` no longer counts all of them as held.
    """
    return p - k + 1 - k * (p // every)


def _least(p: int, every: int = 6) -> int:
    """The same for passages of ``p`` words or more; none of them may be whole."""
    return max(0, min(_whole(q) for q in range(p, p + every)))


def _held(size: int) -> int:
    """Words that the passages of a leaked item hold at least, see ``leaks``."""
    return max(5, -(-3 * size // 10))


@lru_cache(maxsize=100_000)
def whole_phrases(size: int) -> tuple[int, int]:
    """How many phrases one or two passages leave whole that hold three tenths of an item of ``size`` words, five or more each.

    The first figure is that of the passage which has more of them, the second that of both.
    """
    held = _held(size)
    ways = [(_least(held), 0)] + [(_least(p), _least(held - p)) for p in range(5, held - 4)]
    return max(1, min(max(w) for w in ways)), max(1, min(sum(w) for w in ways))


@lru_cache(maxsize=100_000)
def other_passage(size: int, most: int) -> int:
    """How many phrases the other passage leaves whole where none has more than ``most``."""
    held = _held(size)
    longest = max((p for p in range(held) if _whole(p) <= most), default=0)
    return max(1, _least(max(5, held - longest)))


class Items:
    """A block of prepared items as word ids. 0 stands for every word that no item has, and parts documents.

    Phrase p stands at the places ``at`` of the items ``item``, both from ``begin[p]`` to before ``begin[p + 1]``.
    """

    def __init__(self, rows: pd.DataFrame, vocab: dict[str, int], k: int = 3) -> None:
        self.ids = rows["item"].tolist()
        self.words = [np.array([vocab[w] for w in ws], dtype=np.int64) for ws in rows["words"]]
        self.own = list(zip(rows["own_from"].tolist(), rows["own_to"].tolist()))
        owners: dict[int, dict[tuple[int, ...], list[tuple[int, int, bool]]]] = defaultdict(lambda: defaultdict(list))
        for n, (ws, some, others) in enumerate(zip(self.words, rows["phrases"], rows["others"])):
            size = min(k, len(ws))
            for places, rare in ((some, True), (others, False)):
                for at in places:
                    owners[size][tuple(ws[at : at + size].tolist())].append((n, at, rare))
        self.phrases = [np.array(list(owners[size]), dtype=np.int64) for size in sorted(owners)]
        entries = [e for size in sorted(owners) for e in owners[size].values()]
        self.begin = np.cumsum([0, *map(len, entries)])
        flat = np.array([x for e in entries for x in e], dtype=np.int64).reshape(-1, 3)
        self.item, self.at, self.rare = flat[:, 0], flat[:, 1], flat[:, 2] > 0
        size = np.array([len(ws) for ws in self.words], dtype=np.int64)
        # A third of the item with every ninth word changed still leaves this many phrases whole.
        self.least_rare = np.maximum(1, size // 16)
        self.least = np.array([whole_phrases(n) for n in size.tolist()], dtype=np.int64).reshape(-1, 2)
        # Words missing and added within a passage, a sixth at most, move it by as many diagonals.
        self.drift = size // 6


def align(item: np.ndarray, doc: np.ndarray, hits: np.ndarray | None = None, gap: int = 9, match: int = 10, miss: int = 10) -> list[tuple[int, int, int, int, int]]:
    """Best local alignments of two word sequences, disjoint in the document; as many as score four words or more.

    Each is (first and last item word, first and last document word, words matched). Given ``hits``
    (document words), it ends when every hit lies in an alignment.
    """
    out = []
    zero = np.arange(len(doc) + 1, dtype=np.int32) * gap
    equal = np.where(item[:, None] == doc[None, :], match, -miss).astype(np.int32)
    shut = np.int32(-(1 << 24))
    score = np.zeros((len(item) + 1, len(doc) + 1), dtype=np.int32)
    best, step = np.empty_like(zero), np.empty_like(zero[1:])

    def fill(lo: int, hi: int) -> None:
        """The scores of the columns after ``lo`` up to ``hi``."""
        # They are kept with gap * column added, so that a gap in the item's words is a running maximum.
        part, left, z, b, s = score[:, lo : hi + 1], score[:, lo].copy(), zero[: hi - lo + 1], best[: hi - lo + 1], step[: hi - lo]
        part[0] = z
        for i in range(1, len(item) + 1):
            np.subtract(part[i - 1], gap, out=b)
            np.maximum(b, z, out=b)
            np.add(part[i - 1, :-1], equal[i - 1, lo:hi], out=s)
            s += gap
            np.maximum(b[1:], s, out=b[1:])
            b[0] = left[i]
            np.maximum.accumulate(b, out=part[i])
        part -= z

    fill(0, len(doc))
    while True:
        i, j = divmod(int(np.argmax(score)), len(doc) + 1)
        if score[i, j] < 4 * match:
            return out
        last_i, last_j, matched = i - 1, j - 1, 0
        first_i, first_j = i - 1, j - 1
        while i and j and score[i, j] > 0:
            here = score[i, j]
            if here == score[i - 1, j - 1] + equal[i - 1, j - 1]:
                if equal[i - 1, j - 1] > 0:
                    matched += 1
                    first_i, first_j = i - 1, j - 1
                i, j = i - 1, j - 1
            elif here == score[i - 1, j] - gap:
                i -= 1
            else:
                j -= 1
        out.append((first_i, last_i, first_j, last_j, matched))
        if hits is not None:
            hits = hits[(hits < first_j) | (hits > last_j)]
            if len(hits) == 0:
                return out
        equal[:, first_j : last_j + 1] = shut
        # No path with a score above zero is wider than this, so scores further on stay.
        fill(first_j, min(len(doc), last_j + 2 + len(item) + match * len(item) // gap))


def search_shard(docs: list[tuple[int, int, np.ndarray]], blocks: Iterable[Items], alphabet: int) -> list[tuple[int, ...]]:
    """Aligned spans of the items of all blocks in the documents of a shard, which is indexed once.

    ``docs``: (doc, place of its first word, word ids below ``alphabet``). Returns doc, item, first and
    last item word, first and last document word, words matched, item words that aren't standing text, item words.
    """
    # Words foreign to all items can't be in a phrase: a stretch of them is kept as one.
    texts, owners, places = [], [], []
    for n, (_, _, ws) in enumerate(docs):
        if len(ws) == 0:
            continue
        keep = (ws != 0) | np.append(True, ws[:-1] != 0)
        at = np.flatnonzero(keep)
        texts += [ws[at], np.zeros(1, dtype=np.int64)]
        owners += [np.full(len(at) + 1, n)]
        places += [at, np.full(1, len(ws))]
    if not texts:
        return []
    text, owner, place = np.concatenate(texts), np.concatenate(owners), np.concatenate(places)
    index = FMIndex(text, alphabet)
    out = []
    for items in blocks:
        hits = []
        known = 0
        for phrases in items.phrases:
            lo, hi = index.search(phrases)
            count = hi - lo
            which = np.repeat(np.arange(len(phrases)), count)
            slots = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[which]
            at = index.locate(slots)
            hits.append(np.stack([owner[at], place[at], which + known]))
            known += len(phrases)
        if not hits:
            continue
        doc, word, phrase = np.concatenate(hits, axis=1)
        by = np.argsort(doc, kind="stable")
        doc, word, phrase = doc[by], word[by], phrase[by]
        # Whole documents, as many at once as have about HITS places of items.
        lot = np.cumsum(items.begin[phrase + 1] - items.begin[phrase]) // HITS
        new = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
        lot = lot[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        for x in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(lot)) + 1):
            for d, n, where in nominated(items, doc[x], word[x], phrase[x]):
                out += _aligned(docs[d], items, n, where)
    return out


def nominated(items: Items, doc: np.ndarray, word: np.ndarray, phrase: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Documents, items that may have leaked into them, and where phrases of the item begin there.

    Given are the places of phrases: document, word and phrase. A pair has enough rare phrases, or else
    enough phrases of any kind in groups that can be passages: on diagonals (document word less item word)
    as close as ``drift``, and as many as one of two passages must have.
    """
    if len(doc) == 0:
        return
    times = items.begin[phrase + 1] - items.begin[phrase]
    hit = np.repeat(np.arange(len(doc)), times)
    entry = np.arange(len(hit)) + np.repeat(items.begin[phrase] - np.cumsum(times) + times, times)
    pair, diagonal = doc[hit] * len(items.words) + items.item[entry], word[hit] - items.at[entry]
    by = np.lexsort((diagonal, pair))
    pair, diagonal, hit, entry = pair[by], diagonal[by], hit[by], entry[by]
    new = np.append(True, pair[1:] != pair[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    item = items.item[entry]
    line = group * int(diagonal.max() - diagonal.min() + items.drift.max() + 1) + diagonal
    end = np.searchsorted(line, line + items.drift[item], side="right")
    close = end - np.arange(len(line))
    rare = items.rare[entry]
    wide = int(word.max()) + 1
    rares = np.bincount(np.unique(group[rare] * wide + word[hit[rare]]) // wide, minlength=len(first))
    n = item[first]
    last = np.append(first[1:], len(line))
    most = np.maximum.reduceat(close, first)
    enough = (rares >= items.least_rare[n]) | ((most >= items.least[n, 0]) & (last - first >= items.least[n, 1]))
    for g in np.flatnonzero(enough).tolist():
        a, b, i = int(first[g]), int(last[g]), int(n[g])
        begins = np.flatnonzero(close[a:b] >= other_passage(len(items.words[i]), int(most[g])))
        edge = np.zeros(b - a + 1, dtype=np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, end[a + begins] - a, -1)
        passage = np.cumsum(edge[:-1]) > 0
        if rares[g] >= items.least_rare[i] or passage.sum() >= items.least[i, 1]:
            yield int(doc[hit[a]]), i, np.unique(word[hit[a:b][passage | rare[a:b]]]).tolist()


def _aligned(of: tuple[int, int, np.ndarray], items: Items, n: int, where: list[int]) -> list[tuple[int, ...]]:
    """The spans of item ``n`` in a document part around its hits, ``where``."""
    item = items.words[n]
    doc, base, ws = of
    places = np.array(where)
    reach = 2 * len(item) + 20
    groups, begin = [], 0
    for k in range(1, len(where) + 1):
        if k == len(where) or where[k] - where[k - 1] > reach:
            groups.append((where[begin], where[k - 1]))
            begin = k
    out = []
    for first, last in groups:
        lo, hi = max(0, first - reach), min(len(ws), last + reach)
        # A window beyond the reach of one item is aligned in overlapping steps, so memory stays bounded.
        step = 40 * len(item) + 400
        for a in range(lo, hi, step):
            b = min(hi, a + step + reach)
            near = places[(places >= a) & (places < b)] - a
            if len(near) == 0:
                continue
            for i0, i1, j0, j1, matched in align(item, ws[a:b], near):
                own = max(0, min(i1, items.own[n][1]) - max(i0, items.own[n][0]) + 1)
                out.append((doc, items.ids[n], i0, i1, base + a + j0, base + a + j1, matched, own, len(item)))
    return out


_SPANS = "doc_id long, item_id long, item_from int, item_to int, doc_from long, doc_to long, matched int, own int, item_words int"
_NAMES = [c.split()[0] for c in _SPANS.split(", ")]


def leaked_spans(
    docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Every aligned span of a test item in a document: which words of which item stand where.

    Items are prepared over all of them (``prepared_items``) and sent out in blocks of at most about
    ``ITEM_BLOCK`` items and ``BLOCK_WORDS`` words; ``PASS_BLOCKS`` blocks are searched in one scan, in
    one index of each shard, so what is broadcast is bounded; more items take further scans. The result
    doesn't depend on the blocks. Null and empty texts hold nothing; rows without doc_id or item_id are
    left out. Further columns play no part; empty tables give an empty result.
    """
    items = cut(prepared_items(bench, item_id, item_text))
    known = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).first()
    blocks = max(1, -(-known.n // ITEM_BLOCK), -(-(known.words or 0) // BLOCK_WORDS))
    # A passage on the border of two parts is whole in one of them, added words included.
    overlap = max(PART_OVERLAP, 3 * (known.longest or 0) + 20)
    part = max(PART_WORDS, overlap)
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where((F.length("text") > 0) & F.col("doc").isNotNull())
    base = spread(base)
    out = None
    for first in range(0, blocks, PASS_BLOCKS):
        found = base.mapInPandas(_searcher(items, first, min(blocks, first + PASS_BLOCKS), blocks, part, overlap), _SPANS)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(items: DataFrame, first: int, end: int, of: int, part: int, overlap: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The search of one scan, for blocks ``first`` to before ``end``."""
    spark = items.sparkSession
    block = F.pmod("key", F.lit(of))
    words = items.where(block.between(first, end - 1)).select(F.explode("words").alias("w")).distinct()
    vocab = {w: n for n, w in enumerate(words.toPandas()["w"], 1)}
    shared = spark.sparkContext.broadcast(vocab)
    parts = [spark.sparkContext.broadcast(Items(items.where(block == b).orderBy("key").toPandas(), vocab)) for b in range(first, end)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = shared.value
        shard: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame(search_shard(shard, (p.value for p in parts), len(ids_of) + 1), columns=_NAMES)

        for pdf in batches:
            for doc, content in zip(pdf["doc"], pdf["text"]):
                ids = np.fromiter((ids_of.get(w, 0) for w in words_of(content)), dtype=np.int64)
                for a in range(0, max(1, len(ids) - overlap), part):
                    shard.append((doc, a, ids[a : a + part + overlap]))
                    size += len(shard[-1][2])
                    if size >= SHARD_WORDS:
                        yield flush()
                        shard, size = [], 0
        if shard:
            yield flush()

    return run


def leaks(spans: DataFrame, share: float = 1 / 3, slack: float = 0.9, least: int = 5) -> DataFrame:
    """Documents and the items of which they hold at least ``share`` of the words in one or two passages.

    Passages whose item words overlap, wherever they stand in the document, are merged, so a word of the
    item counts once, as the best of them holds it. ``slack`` allows for words that were changed within the
    passages. A passage with fewer than ``least`` words besides standing instructions and closing questions
    is none. Returns doc_id, item_id, words_found, item_words, doc_from, doc_to (the passages' outer bounds).
    """
    span = F.col("item_to") - F.col("item_from") + 1
    pair = ["doc_id", "item_id"]
    # The words a passage stands for lie between those matched and those spanned. Equal ranges
    # are one, so a pair has no more of them than its item has ranges.
    ranges = (
        spans.where((F.col("matched") >= least) & (F.col("own") >= least))
        .withColumn("held", F.least(span.cast("int"), (F.col("matched") * 1.2).cast("int")))
        .groupBy(*pair, "item_from", "item_to")
        .agg(F.max("held").alias("held"), F.min("doc_from").alias("doc_from"), F.max("doc_to").alias("doc_to"), F.first("item_words").alias("item_words"))
    )
    w = Window.partitionBy(*pair).orderBy("item_from", "item_to")
    before = F.max("item_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = ranges.withColumn("_new", F.when(F.col("item_from") <= before, 0).otherwise(1)).withColumn("_passage", F.sum("_new").over(w))
    words = merged.withColumn("_share", F.col("held") / span).withColumn("_word", F.explode(F.sequence("item_from", "item_to")))
    best = (
        words.groupBy(*pair, "_passage", "_word")
        .agg(F.max("_share").alias("_share"), F.min("doc_from").alias("doc_from"), F.max("doc_to").alias("doc_to"), F.first("item_words").alias("item_words"))
        .groupBy(*pair, "_passage")
        .agg(F.round(F.sum("_share")).cast("int").alias("held"), F.min("doc_from").alias("doc_from"), F.max("doc_to").alias("doc_to"), F.first("item_words").alias("item_words"))
        .groupBy(*pair)
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("held", "doc_from", "doc_to")), asc=False), 1, 2).alias("top"), F.first("item_words").alias("item_words"))
    )
    found = F.aggregate("top", F.lit(0), lambda s, x: s + x["held"])
    return best.select(
        "doc_id",
        "item_id",
        found.alias("words_found"),
        "item_words",
        F.array_min(F.col("top.doc_from")).alias("doc_from"),
        F.array_max(F.col("top.doc_to")).alias("doc_to"),
    ).where(F.col("words_found") >= F.col("item_words") * share * slack)


def removal_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 5, **rule: float) -> DataFrame:
    """What to remove: doc_id, from_char, to_char (first character and first one after), n_words, items.

    The passages of all items that leaked into a document (``leaks`` with ``rule``), merged where they
    overlap or touch, wherever they came from. Characters are those of the text as it is, found again
    from the word numbers, so markup and broken characters within a passage go with it.
    """
    leaked = leaks(spans, least=least, **rule).select("doc_id", "item_id")
    held = spans.where((F.col("matched") >= least) & (F.col("own") >= least)).join(leaked, ["doc_id", "item_id"]).select("doc_id", "item_id", "doc_from", "doc_to").distinct()
    w = Window.partitionBy("doc_id").orderBy("doc_from", "doc_to", "item_id")
    before = F.max("doc_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_new", F.when(F.col("doc_from") <= before + 1, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w))
    merged = held.groupBy("doc_id", "_n").agg(F.min("doc_from").alias("a"), F.max("doc_to").alias("b"), F.array_sort(F.collect_set("item_id")).alias("items"))
    per_doc = merged.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "items")).alias("spans"))
    full = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(per_doc, "doc_id")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content, found in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                for x in found:
                    rows.append((doc, *char_span(content, x["a"], x["b"]), x["b"] - x["a"] + 1, list(x["items"])))
            yield pd.DataFrame(rows, columns=["doc_id", "from_char", "to_char", "n_words", "items"])

    return full.mapInPandas(place, "doc_id long, from_char long, to_char long, n_words long, items array<long>").distinct()


def char_span(text: str, first: int, last: int) -> tuple[int, int]:
    """The characters of ``text`` that hold its words ``first`` to ``last`` as ``words_of`` numbers them."""

    def words_before(at: int) -> int:
        return len(words_of(text[:at]))

    def least(want: int) -> int:
        lo, hi = 0, len(text)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if words_before(mid) >= want else (mid + 1, hi)
        return lo

    begin = max(0, least(first + 1) - 1)
    end = least(last + 1)
    whole = len(words_of(text[begin:end]))
    while end < len(text) and text[end].isalnum() and len(words_of(text[begin : end + 1])) == whole:
        end += 1  # to the end of the last word
    return begin, end
