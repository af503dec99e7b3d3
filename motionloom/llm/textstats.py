"""Per-document text figures, and which documents are not prose.

Method: documents longer than a bound are cut into chunks at line ends or white space and
spread over the cluster; every chunk gives additive counts, corrected by the state at
its edges (a word or a line that goes on across an edge counts once, a repeated line is known by
the lines before); the counts are summed per document through partial aggregation and turned into
ratios and an outcome. Which blocks of a text are running language is told by a model fitted on
hand-labelled documents.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.llm import prose
from motionloom.llm.prose import CHUNK, EDGE, split_points
from motionloom.operators.trees import TreeModel, train_trees
from motionloom.runtime import cut, spread

_COUNTS = ("n_dense", "n_words", "word_chars", "n_common", "n_symbols", "n_digits", "n_lines", "n_ended", "n_bullets", "n_running")
PROSE = ("not prose", "prose")


def chunk_counts(text: str, before: str = "", after: str = "") -> list[int]:
    """Additive counts of a chunk; ``before`` and ``after`` are the ``EDGE`` characters on either side of it."""
    words = prose._WORD.findall(text)
    word_chars = sum(map(len, words))
    lines = [x for x in prose._NEWLINE.split(text) if x.strip()]
    n_words, n_lines = len(words), len(lines)
    # A word or line that began in the chunk before counts there, not here.
    if before[-1:].isalpha() and text[:1].isalpha():
        n_words -= 1
    if prose._NEWLINE.split(before)[-1].strip() and prose._NEWLINE.split(text)[0].strip():
        n_lines -= 1
    ended = [bool(prose._END.search(x)) for x in lines]
    if prose._NEWLINE.split(text)[-1].strip() and prose._NEWLINE.split(after)[0].strip():
        ended.pop()  # its end comes in the next chunk
    dense = "".join(text.split())
    return [
        len(dense),
        n_words,
        word_chars,
        sum(w.lower().replace("’", "'") in prose.COMMON for w in words),
        len(dense) - sum(map(str.isalnum, dense)),
        sum(map(str.isdigit, dense)),
        n_lines,
        sum(ended),
        sum(bool(prose._BULLET.match(x)) for x in lines),
    ]


def running_chars(texts: list[str], befores: list[str], model: TreeModel | None) -> list[int]:
    """Characters in blocks of running language, for each text; one call of the model for all of them."""
    at, size, figures = [], [], []
    for n, (text, before) in enumerate(zip(texts, befores)):
        for chars, block in prose.blocks(text, before):
            if block is not None:
                at.append(n)
                size.append(chars)
                figures.append(block)
    if not figures or model is None:
        return [0] * len(texts)
    good = model.predict(np.array(figures))[:, model.labels.index("prose")] > 0.5
    return np.bincount(at, np.array(size) * good, len(texts)).astype(int).tolist()


def _first(batches: Iterator[pd.DataFrame], model: TreeModel | None) -> Iterator[pd.DataFrame]:
    """The counts of short texts; the chunks of long ones, uncounted."""
    for pdf in batches:
        text = [unicodedata.normalize("NFC", t) for t in pdf["text"]]
        short = [len(t) <= CHUNK for t in text]
        size = pdf["text"].map(len)
        few = [t for t, ok in zip(text, short) if ok]
        yield _counted(pdf["doc"][short], size[short], few, [""] * len(few), [""] * len(few), model)
        for doc, n, t, ok in zip(pdf["doc"], size, text, short):
            parts = [] if ok else split_points(t)
            for k in range(0, len(parts), 64):
                some = parts[k : k + 64]
                out = pd.DataFrame({c: pd.Series([None] * len(some), dtype="Int64") for c in _COUNTS})
                out.insert(0, "doc", doc)
                out.insert(1, "n_chars", [0 if k + i else n for i in range(len(some))])
                out["chunk"] = [t[a:b] for a, b in some]
                out["before"] = [t[max(0, a - EDGE) : a] for a, _ in some]
                out["after"] = [t[b : b + EDGE] for _, b in some]
                yield out


def _second(batches: Iterator[pd.DataFrame], model: TreeModel | None) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = _counted(pdf["doc"], pdf["n_chars"], pdf["chunk"].to_list(), pdf["before"].to_list(), pdf["after"].to_list(), model)
        yield out.drop(columns=["chunk", "before", "after"])


def _counted(doc: pd.Series, n_chars: pd.Series, text: list[str], before: list[str], after: list[str], model: TreeModel | None) -> pd.DataFrame:
    rows = [chunk_counts(t, b, a) for t, b, a in zip(text, before, after)]
    out = pd.DataFrame(rows, columns=list(_COUNTS[:-1]), dtype="int64")
    out["n_running"] = running_chars(text, before, model)
    out.insert(0, "doc", doc.to_numpy())
    out.insert(1, "n_chars", n_chars.to_numpy())
    for c in ("chunk", "before", "after"):
        out[c] = pd.Series([None] * len(out), dtype=object)
    return out


def labelled(kinds: DataFrame, doc_id: str = "doc_id", kind: str = "kind") -> DataFrame:
    """doc, prose of every document on which most coders agree, whatever the case of their labels; a tie tells nothing."""
    name = F.lower(F.trim(kind))
    votes = kinds.where(F.col(doc_id).isNotNull() & (name != "")).groupBy(F.col(doc_id).cast("long").alias("doc"))
    share = votes.agg(F.avg((name == "prose").cast("int")).alias("share"))
    return share.where("share <> 0.5").select("doc", (F.col("share") > 0.5).alias("prose"))


def fit_running_language(
    df: DataFrame, kinds: DataFrame, doc_id: str = "doc_id", text: str = "text", most_docs: int = 5_000, most_blocks: int = 20_000, rounds: int = 40
) -> TreeModel | None:
    """A model that tells blocks of running language from others, fitted on hand-labelled documents.

    The fit, and nothing else, uses a bounded sample: at most ``most_docs`` labelled documents and ``most_blocks``
    of their blocks, in hash order. A block is first taken to be what its document is; as documents mix and coders
    err, models fitted on two thirds of the documents then relabel the blocks of the last third that they clearly
    tell otherwise, and the model is fitted on those labels. None where the sample hasn't both kinds.
    """
    some = labelled(kinds, doc_id).orderBy(F.xxhash64("doc"), "doc").limit(most_docs)
    docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("text is not null")

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, n, bool(label), block)
                for doc, label, t in zip(pdf["doc"], pdf["prose"], pdf["text"])
                for n, (_, block) in enumerate(prose.blocks(unicodedata.normalize("NFC", t)))
                if block is not None
            ]
            yield pd.DataFrame(rows, columns=["doc", "n", "prose", "figures"])

    told = docs.join(F.broadcast(some), "doc").mapInPandas(tell, "doc long, n long, prose boolean, figures array<double>")
    told = told.withColumn("fold", F.pmod(F.xxhash64("doc"), F.lit(3)))
    rows = told.orderBy(F.xxhash64("doc", "n"), "doc", "n", "figures").limit(most_blocks).toPandas()
    if rows["prose"].nunique() < 2:
        return None
    x, given = np.stack(rows["figures"].map(np.asarray).to_list()), rows["prose"].to_numpy().astype(int)
    p, fold = given.astype(float), rows["fold"].to_numpy()
    for f in range(3):
        rest = fold != f
        if (fold == f).any() and len(set(given[rest])) == 2:
            p[fold == f] = train_trees(x[rest], given[rest], PROSE, rounds=rounds).predict(x[fold == f])[:, 1]
    clear = np.where(p > 0.8, 1, np.where(p < 0.2, 0, given))
    return train_trees(x, clear if len(set(clear)) == 2 else given, PROSE, rounds=rounds)


def text_statistics(df: DataFrame, model: TreeModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: figures of its text and whether more than half of it is no running language.

    ``model`` (``fit_running_language``) tells which blocks are running language; without one running_share is null
    and not_prose false.

    Columns: doc_id, n_chars, n_words, mean_word_length, symbol_ratio, digit_ratio, n_lines,
    ended_line_share, bullet_line_share, common_word_share, running_share, not_prose.
    Null, empty and blank texts get zero counts, null ratios and not_prose false. Texts of any
    length are read whole, in one scan: long ones leave it as chunks, are spread and counted apart; where
    chunks are cut doesn't change any figure. Texts with the same doc_id are summed as parts of one document; rows
    without doc_id are left out. Further columns of ``df`` play no part; an empty table gives an empty result.
    """
    base = df.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc is not null")
    counts = ", ".join(f"{c} long" for c in ("n_chars", *_COUNTS))
    shared = df.sparkSession.sparkContext.broadcast(model)  # some dozens of small trees
    first = cut(spread(base).mapInPandas(lambda b: _first(b, shared.value), f"doc long, {counts}, chunk string, before string, after string"))
    long = first.where("chunk is not null").select("doc", "n_chars", "chunk", "before", "after").repartition(F.xxhash64("doc", "chunk"))
    parts = first.where("chunk is null").drop("chunk", "before", "after").unionByName(long.mapInPandas(lambda b: _second(b, shared.value), f"doc long, {counts}"))
    total = parts.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("n_chars", *_COUNTS)])

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b))

    return total.select(
        F.col("doc").alias("doc_id"),
        "n_chars",
        "n_words",
        ratio("word_chars", "n_words").alias("mean_word_length"),
        ratio("n_symbols", "n_dense").alias("symbol_ratio"),
        ratio("n_digits", "n_dense").alias("digit_ratio"),
        "n_lines",
        ratio("n_ended", "n_lines").alias("ended_line_share"),
        ratio("n_bullets", "n_lines").alias("bullet_line_share"),
        ratio("n_common", "n_words").alias("common_word_share"),
        (ratio("n_running", "n_dense") if model else F.lit(None).cast("double")).alias("running_share"),
        ((F.col("n_running") * 2 < F.col("n_dense")) if model else F.lit(False)).alias("not_prose"),
    )
