"""Evaluation passages inside a training corpus, found by winnowing."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, written

#: Words a fingerprint covers, and fingerprints a window holds: every shared run
#: of at least ``GRAM + WINDOW - 1`` words has a fingerprint in common.
GRAM, WINDOW = 5, 4
#: Extension: exact runs of words, and the words a copy may have changed between them.
RUN, GAP, DRIFT = 3, 4, 2
#: Part of an item's words a document must hold. Half by definition; words that
#: were changed inside a copied half cost it up to a tenth of the half.
LEAST_PART = 0.45
#: Items, and bytes of their texts, that are sent to every executor; larger sets are joined.
MOST_BROADCAST, MOST_BYTES = 20_000, 16 * 2**20
WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_぀-ヿ㐀-鿿฀-๿]+")


def words(text: str | None) -> list[str]:
    """Case-folded words; characters of scripts without spaces stand alone."""
    return WORD.findall(unicodedata.normalize("NFKC", text).casefold()) if text else []


def grams(tokens: list[str]) -> list[int]:
    """Hashes of all runs of ``GRAM`` words; a shorter text is one run."""
    if not tokens:
        return []
    return [xxhash.xxh3_64_intdigest(" ".join(tokens[i : i + GRAM])) - 2**63 for i in range(max(1, len(tokens) - GRAM + 1))]


def winnow(hashes: list[int]) -> set[int]:
    """The least hash of every window."""
    return {min(hashes[i : i + WINDOW]) for i in range(max(1, len(hashes) - WINDOW + 1))} if hashes else set()


def shared_part(item: list[str], doc: list[str]) -> float:
    """Part of the item's words in the best chain of exact runs in item order.

    Runs of one diagonal follow one another, so of each diagonal only its last
    runs can be continued: a run is held against those few, not against all."""
    at = defaultdict(list)
    for i in range(len(item) - RUN + 1):
        at[tuple(item[i : i + RUN])].append(i)
    ends: dict[int, int] = {}
    chains: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by diagonal: start and end in the item, best score
    best = 0
    for j in range(len(doc) - RUN + 1):
        for i in at.get(tuple(doc[j : j + RUN]), ()):
            diagonal = j - i
            if ends.get(diagonal, -1) > i:
                continue  # within the run that is known
            n = RUN
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            ends[diagonal] = i + n - RUN + 1
            score = n
            for d in range(diagonal - DRIFT, diagonal + DRIFT + 1):
                for i0, end0, before in reversed(chains[d]):
                    gap_item, gap_doc = i - end0, j - (end0 + d)
                    if gap_item > GAP or gap_doc > GAP:
                        break
                    both = max(0, -gap_item, -gap_doc)
                    if i0 < i and i0 + d < j and both < n:
                        score = max(score, before + n - both)
            chains[diagonal].append((i, i + n, score))
            best = max(best, score)
    return best / max(1, len(item))


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(k, h) for k, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for h in winnow(grams(words(t)))]
        yield pd.DataFrame(rows, columns=["id", "print"]).astype("int64")


def _item_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(k, h) for k, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for h in set(grams(words(t)))]
        yield pd.DataFrame(rows, columns=["item_id", "print"]).astype("int64")


OUT = "doc_id long, item_id long, part double"


def _covered(item: list[str], runs: set[tuple[str, ...]]) -> float:
    """Part of the item's words in runs a document has too: ``shared_part`` is no more."""
    end = n = 0
    for i in range(len(item) - RUN + 1):
        if tuple(item[i : i + RUN]) in runs:
            n += i + RUN - max(end, i)
            end = i + RUN
    return n / max(1, len(item))


def _runs(doc: list[str]) -> set[tuple[str, ...]]:
    return {tuple(doc[j : j + RUN]) for j in range(len(doc) - RUN + 1)}


def _by_broadcast(documents: DataFrame, items: dict[str, list[int]]) -> DataFrame:
    """One pass over the documents: no shuffle, no second read of their texts."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [(words(t), ids) for t, ids in shared.value.items()]
        holders: dict[int, list[int]] = defaultdict(list)
        for k, (w, _) in enumerate(texts):
            for h in set(grams(w)):
                holders[h].append(k)
        for f in frames:
            out = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                w = words(text)
                hit = {k for h in winnow(grams(w)) for k in holders.get(h, ())}
                runs = _runs(w) if hit else set()
                for k in hit:
                    item, ids = texts[k]
                    if _covered(item, runs) >= LEAST_PART and (part := shared_part(item, w)) >= LEAST_PART:
                        out += [(doc_id, i, part) for i in ids]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "part"]).astype({"doc_id": "int64", "item_id": "int64", "part": "float64"})

    return documents.mapInPandas(find, OUT)


def _by_join(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The same for test sets of any size: fingerprints are joined by hash."""
    named = written(items.withColumn("text_id", F.xxhash64("text")), "leak-items")
    # equal hashes of different texts stay apart by the text
    texts = named.select(F.col("text_id").alias("item_id"), "text").distinct()
    prints = texts.mapInPandas(_item_grams, "item_id long, print long")
    found = spread(documents.mapInPandas(_fingerprints, "id long, print long"), "print").join(prints, "print")
    pairs = found.select("id", "item_id").distinct()
    doc_texts = documents.select(F.col("doc_id").alias("id"), F.col("text").alias("doc_text"))
    rows = pairs.join(doc_texts, "id").join(texts.withColumnRenamed("text", "item_text"), "item_id").select("id", "item_id", "doc_text", "item_text")

    def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            part = []
            for d, i in zip(f["doc_text"], f["item_text"], strict=True):
                doc, item = words(d), words(i)
                part.append(shared_part(item, doc) if _covered(item, _runs(doc)) >= LEAST_PART else 0.0)
            out = pd.DataFrame({"doc_id": f["id"], "text_id": f["item_id"], "item_text": f["item_text"], "part": part})
            yield out[out["part"] >= LEAST_PART]

    leaks = rows.mapInPandas(extend, "doc_id long, text_id long, item_text string, part double")
    same = (F.col("text_id") == F.col("_k")) & (F.col("item_text") == F.col("text"))
    return leaks.join(named.select(F.col("text_id").alias("_k"), "item_id", "text").distinct(), same).select("doc_id", "item_id", "part")


def find_leaks(documents: DataFrame, items: DataFrame, most_broadcast: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Documents that hold at least half of an item: ``doc_id, item_id, part``.

    Method: winnowing. Documents keep the least hash of every window of
    ``WINDOW`` consecutive hashes of ``GRAM`` words; items keep all hashes, so
    every shared run of ``GRAM + WINDOW - 1`` words is met. Every pair with a
    hit is judged by the words it can share at most, then by its best chain of
    exact runs in item order with small gaps; how many items share a hit does
    not matter.

    Up to ``most_broadcast`` items of ``most_bytes`` in all (counted and summed
    first) the items go to every executor and documents are read once without a
    shuffle; beyond either, fingerprints are joined. Both ways give the same rows. Defined results: null or empty texts leak nothing;
    equal items leak together, looked up once; repeated documents each give their rows; items
    under ``GRAM`` words can only be met by documents equal to them; extra
    columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
    tests = items.select(F.col("item_id").cast("long"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    size = tests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= most_broadcast and size["bytes"] <= most_bytes:
        texts: dict[str, list[int]] = defaultdict(list)
        for item_id, text in tests.collect():
            texts[text].append(item_id)
        found = _by_broadcast(docs, dict(texts))
    else:
        found = _by_join(docs, tests)
    return found.groupBy("doc_id", "item_id").agg(F.max("part").alias("part"))
