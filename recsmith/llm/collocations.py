"""Operator 13: phrase collocations by dynamic itemset counting."""

from __future__ import annotations

import math
import uuid
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, cut_lineage, ensure_checkpoint_dir, release_shuffles, remove_folder

#: Shards of one cycle: longer phrases may start after each (every step is a few small jobs besides its scan).
SHARDS = 2
#: Text bytes that a task counts at a time.
SLICE = 4 << 20
#: Bits of the broadcast filter of frequent phrases: 16 for each phrase within these bounds.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
BLOCK_BYTES = 1 << 13
#: Rows of the last scan that a task holds to add them up before they leave it.
HELD_ROWS = 1 << 19
#: Sets the second hash of words and languages apart from the first.
CHECK_SALT = 0x3C79AC492BA7B653

#: Word, gap (space, tab) or end of a piece, for each byte value; A-Z in lower case.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_EDGE = np.zeros(1, np.int8)


# ---------------------------------------------------------------- hashes and the filter of frequent phrases
def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extend(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word and that of the last word."""
    return _mix(head * np.uint64(0x9E3779B97F4A7C15) + word)


def string_hashes(strings: pa.StringArray, salt: int = 0x632BE59BD9B4E019) -> np.ndarray:
    """A hash of each string: its bytes weighed by pseudo-random numbers of their places."""
    n = len(strings)
    offsets = np.frombuffer(strings.buffers()[1], np.int32, n + 1, offset=4 * strings.offset).astype(np.int64)
    sizes = np.diff(offsets)
    if not n or not sizes.sum():
        return _mix(np.zeros(n, np.uint64))
    data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    place = _mix(np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(salt))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * place[at], dtype=np.uint64)])
    return _mix(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]] + sizes.astype(np.uint64))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mix(hashes + np.uint64(salt)) & np.uint64(bits - 1)).astype(np.int64) for salt in (11, 23, 47)]


class PhraseFilter(NamedTuple):
    """Bloom filters of the phrases that have reached the threshold (``known``), and of those that did so
    within the last ``1, 2, ...`` steps (``recent``)."""

    bits: int
    known: np.ndarray
    recent: tuple[np.ndarray, ...]

    @staticmethod
    def _holds(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
        held = np.ones(len(hashes), dtype=bool)
        for at in _places(hashes, bits):
            held &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return held

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each phrase is known, and the steps since it became so (``len(recent)``: more than a cycle)."""
        known = self._holds(self.known, hashes, self.bits)
        some = np.nonzero(known)[0]
        age, ages = np.full(len(hashes), len(self.recent), np.int8), np.full(len(some), len(self.recent), np.int8)
        for steps in range(len(self.recent) - 1, -1, -1):
            ages[self._holds(self.recent[steps], hashes[some], self.bits)] = steps
        age[some] = ages
        return known, age


def phrase_filter(frequent: DataFrame, step: int, shards: int, n: int) -> PhraseFilter:
    """The filters of ``frequent`` (``h, reached``) for the scan of ``step``: ``recent[a]`` has ``reached >= step - 1 - a``.

    Tasks set bits, equal blocks of bits are merged in Spark, and what reaches the driver
    is bounded by ``MAX_BITS`` whatever the number of phrases: a fuller filter lets more
    phrases through to the counts, none less.
    """
    bits = min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(16 * max(1, n)))))

    def run(batches):
        tables = np.zeros((1 + shards, bits // 8), np.uint8)
        for batch in batches:
            hashes, age = batch.column(0).to_numpy().view(np.uint64), step - 1 - batch.column(1).to_numpy()
            for at in _places(hashes, bits):
                for a, table in enumerate(tables):
                    rows = at if a == 0 else at[age < a]
                    np.bitwise_or.at(table, rows >> 3, np.left_shift(1, rows & 7).astype(np.uint8))
        for which, table in enumerate(tables):
            blocks = table.reshape(-1, BLOCK_BYTES)
            used = np.nonzero(blocks.any(axis=1))[0]
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), which), pa.int32()), pa.array(used, pa.int32()), pa.array([blocks[b].tobytes() for b in used], pa.binary())],
                    names=["which", "block", "bits"],
                )

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(BLOCK_BYTES, np.uint8)
        for held in part["bits"]:
            table |= np.frombuffer(held, np.uint8)
        return pd.DataFrame({"which": [key[0]], "block": [key[1]], "bits": [table.tobytes()]})

    schema = "which int, block int, bits binary"
    blocks = frequent.select("h", "reached").mapInArrow(run, schema)
    tables = np.zeros((1 + shards, bits // 8 // BLOCK_BYTES, BLOCK_BYTES), np.uint8)
    # a block appears once for each task that set bits in it
    for row in blocks.groupBy("which", "block").applyInPandas(merge, schema).collect():
        tables[row["which"], row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return PhraseFilter(bits, tables[0].reshape(-1), tuple(t.reshape(-1) for t in tables[1:]))


# ---------------------------------------------------------------- words of a slice
class Slice:
    """The words of some texts: numbers exact within the slice, hashes for the filter.

    ``word`` numbers the words, ``key`` the pairs of language and word, ``piece`` the pieces
    (never over two texts), ``row`` the texts, ``own`` tells words that start phrases of this
    slice from those that only follow a cut, ``text_key`` holds the texts' keys.
    """

    def __init__(self, langs: pa.StringArray, texts: pa.StringArray, own_bytes: np.ndarray | None = None, keys: np.ndarray | None = None):
        langs = langs.dictionary_encode()
        raw = [t.as_buffer() for t in texts]
        joined = b"\n".join(raw) + b"\n"
        starts_of = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw])]).astype(np.int64)
        data = np.frombuffer(joined, np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edge = np.diff(np.concatenate([_EDGE, inside.view(np.int8), _EDGE]))
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        letters = _LOWER[data[inside]]
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())).dictionary_encode()
        self.vocabulary = words.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        self.row = np.searchsorted(starts_of, start, side="right") - 1
        self.own = np.ones(len(start), dtype=bool) if own_bytes is None else start - starts_of[self.row] < own_bytes[self.row]
        self.langs = langs.dictionary
        self.v = max(1, len(self.vocabulary))
        self.key = langs.indices.to_numpy().astype(np.int64)[self.row] * self.v + self.word
        self.bare_hash = string_hashes(self.vocabulary)
        self.lang_hash = string_hashes(self.langs)
        self.word_hash = _extend(np.repeat(self.lang_hash, len(self.vocabulary)), np.tile(self.bare_hash, len(self.langs)))
        self.word_check, self.lang_check = string_hashes(self.vocabulary, CHECK_SALT), string_hashes(self.langs, CHECK_SALT)
        self.text_key = np.zeros(len(raw), np.int32) if keys is None else keys

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """A second hash, of 23 bits (few, as every row shuffles it), of the phrases of ``k`` words at these places (0 words: of their languages)."""
        total = self.lang_check[self.key[at] // self.v]
        for i in range(k):
            total = total * np.uint64(0xD1342543DE82EF95) + self.word_check[self.word[at + i]]
        return (_mix(total) >> np.uint64(41)).astype(np.int32)

    def phrases(self, at: np.ndarray, k: int) -> pa.StringArray:
        return pc.binary_join_element_wise(*[self.vocabulary.take(pa.array(self.word[at + i])) for i in range(k)], " ")


def _grow(part: Slice, table: PhraseFilter, longest: int):
    """For each length from 2: ``(length, places, hashes, age, known)`` of the phrases both of whose next shorter
    parts the filter holds; the age is the younger part's."""
    n = len(part.word)
    held, age = (found[part.key] for found in table.look(part.word_hash))
    hashes = part.word_hash[part.key]
    for k in range(2, longest + 1):
        m = max(0, n - k + 1)
        at = np.nonzero(held[:m] & held[1 : m + 1] & (part.piece[:m] == part.piece[k - 1 :]))[0]
        if not len(at):
            return
        found = _extend(hashes[at], part.bare_hash[part.word[at + k - 1]])
        known, ages = table.look(found)
        yield k, at, found, np.minimum(age[at], age[at + 1]), known
        hashes, held, age = np.zeros(n, np.uint64), np.zeros(n, bool), np.zeros(n, np.int8)
        hashes[at], held[at], age[at] = found, known, ages


def _tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the number of each row's value among them."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


class Marks(NamedTuple):
    """Of each counted phrase: the step it became active, its second hash (-1: phrases that differ share its hash),
    and the key of a text that holds it."""

    since: np.ndarray
    check: np.ndarray
    key: np.ndarray


def _counted(part: Slice, at: np.ndarray, k: int, hashes: np.ndarray, since: np.ndarray):
    """Counts and marks of the phrases of ``k`` words at these places, by hash."""
    kinds, which = _tally(hashes.view(np.int64))
    checks, place = part.checks(at, k), np.zeros(len(kinds), np.int64)
    place[which] = np.arange(len(at))
    check = checks[place]
    check[which[check[which] != checks]] = -1
    return kinds, k, np.bincount(which, minlength=len(kinds)), Marks(since[place], check, part.text_key[part.row[at[place]]])


def count_active(part: Slice, table: PhraseFilter | None, step: int, singles: bool, longest: int):
    """``(hashes, words, hits, marks)`` of what this step counts: single words in the first cycle, and longer phrases
    that became active (at step ``since``) when the younger of their next shorter parts reached the threshold, within a cycle."""
    if singles and len(part.word):
        at = np.nonzero(part.own)[0]
        yield _counted(part, at, 1, part.word_hash[part.key[at]], np.zeros(len(at), np.int32))
    if table is None:
        return
    for k, at, found, age, _ in _grow(part, table, longest):
        take = part.own[at] & (age < len(table.recent))
        if take.any():
            yield _counted(part, at[take], k, found[take], step - age[take].astype(np.int32))


def count_languages(part: Slice):
    """Each language's word occurrences, as phrases of 0 words."""
    at = np.nonzero(part.own)[0]
    return _counted(part, at, 0, part.lang_hash[part.key[at] // part.v], np.zeros(len(at), np.int32))


def name_wanted(part: Slice, wanted: np.ndarray, longest: int):
    """``(langs, phrases, words, hashes, checks)`` of the phrases of this slice, each once, whose hashes are among ``wanted`` (ascending)."""

    def of(at, k, hashes):
        hashes = hashes.view(np.int64)
        near = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
        some = np.nonzero(wanted[near] == hashes)[0]
        checks = part.checks(at[some], k)
        order = np.lexsort((checks, hashes[some]))
        some, checks = some[order], checks[order]
        first = np.ones(len(some), bool)
        first[1:] = (hashes[some[1:]] != hashes[some[:-1]]) | (checks[1:] != checks[:-1])
        some, checks = some[first], checks[first]
        phrases = part.phrases(at[some], k) if k else pa.array([""] * len(some), pa.string())
        return part.langs.take(pa.array(part.key[at[some]] // part.v)), phrases, k, hashes[some], checks

    at = np.nonzero(part.own)[0]
    if not len(at) or not len(wanted):
        return
    yield of(at, 0, part.lang_hash[part.key[at] // part.v])
    hashes = part.word_hash[part.key[at]]
    yield of(at, 1, hashes)
    for k in range(2, longest + 1):
        inside = at + k <= len(part.word)
        at, hashes = at[inside], hashes[inside]
        inside = part.piece[at] == part.piece[at + k - 1]
        at, hashes = at[inside], hashes[inside]
        if not len(at):
            return
        hashes = _extend(hashes, part.bare_hash[part.word[at + k - 1]])
        yield of(at, k, hashes)


def count_known(part: Slice, table: PhraseFilter, longest: int, only: PhraseFilter | None = None):
    """``(langs, phrases, words, hits)`` of the phrases that the filter holds (and ``only``, if given), told apart by
    their words; and each language's word occurrences, as phrase null with 0 words."""
    count = np.bincount(part.key[part.own], minlength=len(part.word_hash))
    total = count.reshape(len(part.langs), -1).sum(axis=1) if len(part.langs) else count
    yield part.langs, pa.nulls(len(part.langs), pa.string()), 0, total
    kinds = np.nonzero((count > 0) & table.look(part.word_hash)[0])[0] if len(part.word) else np.zeros(0, np.int64)
    if only is not None:
        kinds = kinds[only.look(part.word_hash[kinds])[0]]
    yield part.langs.take(pa.array(kinds // part.v)), part.vocabulary.take(pa.array(kinds % part.v)), 1, count[kinds]
    number = part.key
    for k, at, found, _, known in _grow(part, table, longest):
        at, found = at[known], found[known]
        kinds, which = _tally(number[at] * part.v + part.word[at + k - 1])
        count = np.bincount(which[part.own[at]], minlength=len(kinds))
        place = np.zeros(len(kinds), np.int64)
        place[which] = np.arange(len(at))
        held = np.nonzero(count)[0]
        if only is not None:
            held = held[only.look(found[place[held]])[0]]
        begin = at[place[held]]
        yield part.langs.take(pa.array(part.key[begin] // part.v)), part.phrases(begin, k), k, count[held]
        number = np.zeros(len(part.word), np.int64)
        number[at] = which


def _segments(data: bytes, longest: int, limit: int = SLICE):
    """``(part, own bytes)`` of a text: cut between words, each part followed by the next ``longest - 1`` words."""
    at = 0
    while len(data) - at > limit:
        cut = _first_gap(data, at + limit)
        stop = cut
        for _ in range(longest - 1):
            stop = _first_gap(data, _first_word(data, stop))
        yield data[at:stop], cut - at
        at = cut
    yield data[at:], len(data) - at


def _scan_for(data: bytes, at: int, word: bool) -> int:
    while at < len(data):
        hit = np.nonzero((_KIND[np.frombuffer(data[at : at + 4096], np.uint8)] == 0) == word)[0]
        if len(hit):
            return at + int(hit[0])
        at += 4096
    return len(data)


def _first_gap(data: bytes, at: int) -> int:
    return _scan_for(data, at, False)


def _first_word(data: bytes, at: int) -> int:
    return _scan_for(data, at, True)


def _slices(batches, longest: int):
    """The words of each few megabytes of ``lang, text, key`` rows."""
    for batch in batches:
        for part in byte_slices(batch, 1, SLICE):
            yield from _words(part, longest)


def _words(part: pa.RecordBatch, longest: int):
    langs, texts, keys = part.column(0), part.column(1), part.column(2).to_numpy()
    if part.num_rows > 1:
        yield Slice(langs, texts, keys=keys)
    else:
        for piece, own in _segments(texts[0].as_buffer().to_pybytes(), longest):
            yield Slice(langs, pa.array([piece], pa.binary()), np.array([own]), keys)


def scan(shard: DataFrame, known, step: int, singles: bool, longest: int) -> DataFrame:
    """One step's counts of a shard's active phrases, one row per slice and phrase: ``h, words, hits`` and its marks."""

    def run(batches):
        table = known.value if known is not None else None
        for part in _slices(batches, longest):
            for hashes, words, hits, marks in chain([count_languages(part)] if singles else [], count_active(part, table, step, singles, longest)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.int64()), pa.array(np.full(len(hits), words), pa.int32()), pa.array(hits, pa.int64()), *(pa.array(m, pa.int32()) for m in marks)],
                    names=["h", "words", "hits", *marks._fields],
                )

    return shard.select("lang", "text", "key").mapInArrow(run, "h bigint, words int, hits bigint, since int, check int, key int")


def _added_up(tables, limit: int = HELD_ROWS):
    """The rows of ``tables`` with equal phrases added up while no more than about ``limit`` are held."""
    held, rows = [], 0
    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows >= limit:
            one = _sum_hits(held)
            held, rows = [one], one.num_rows
            if rows >= limit // 2:
                yield from one.to_batches()
                held, rows = [], 0
    if held:
        yield from _sum_hits(held).to_batches()


def _sum_hits(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "phrase", "words"]
    return pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("hits", "sum")]).rename_columns([*keys, "hits"])


def scan_known(texts: DataFrame, known, longest: int, only) -> DataFrame:
    """Counts of both filters' phrases by their words, added up over a task's slices: ``lang, phrase, words, hits``."""

    def tables(batches):
        for part in _slices(batches, longest):
            for lang, phrase, words, hits in count_known(part, known.value, longest, only.value):
                yield pa.table({"lang": lang, "phrase": phrase, "words": pa.array(np.full(len(hits), words), pa.int32()), "hits": pa.array(hits, pa.int64())})

    return texts.select("lang", "text", "key").mapInArrow(lambda batches: _added_up(tables(batches)), "lang string, phrase string, words int, hits bigint")


def scan_names(texts: DataFrame, longest: int) -> DataFrame:
    """The words of each text's ``wanted`` hashes: ``h, words, check, lang, phrase``."""

    def run(batches):
        for batch in batches:
            for rows in byte_slices(batch, 1, SLICE):
                wanted = np.unique(rows.column(3).flatten().to_numpy())
                for part in _words(rows, longest):
                    for langs, phrases, words, hashes, checks in name_wanted(part, wanted, longest):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(hashes, pa.int64()), pa.array(np.full(len(hashes), words), pa.int32()), pa.array(checks, pa.int32()), langs, phrases],
                            names=["h", "words", "check", "lang", "phrase"],
                        )

    return texts.select("lang", "text", "key", "wanted").mapInArrow(run, "h bigint, words int, check int, lang string, phrase string")


def one_phrase() -> Column:
    """Whether all that was counted under a hash was one phrase: its second hash was always the same."""
    return (F.col("low") == F.col("high")) & (F.col("low") >= 0)


# ---------------------------------------------------------------- cycles
def frequent_phrases(docs: DataFrame, threshold: int, longest: int, shards: int = SHARDS) -> DataFrame:
    """``lang, phrase, words, hits`` of all phrases of 1 to ``longest`` words found ``threshold`` times, and,
    as an empty phrase of 0 words, each language's word occurrences.  ``docs`` has ``lang, text, _id`` without null texts.

    Step ``t`` scans shard ``t % shards``.  Single words are counted over the first cycle.  A
    longer phrase becomes active at the step after both its next shorter parts have reached the
    threshold in what is counted so far, and is counted for one full cycle.  Scans find
    active phrases by a bounded broadcast filter, and count them by 64-bit hash.  Counts stand by shard and
    a shard's later count of a phrase replaces a smaller earlier one.  Phrases that share a hash, and phrases that
    the filter lets through out of turn, only raise a count or keep it for longer, so every phrase found
    ``threshold`` times reaches it; phrases that end their cycle below it are dropped.  Counts carry a second,
    independent hash and the least key of a text: a phrase that had its hash to itself (told by the second hash) was counted
    in full, and its words are read once, from that text.  Where phrases share a hash, one more scan counts them by
    their words.  Counts live in written tables, a step is one shuffle of numbers; only the filter's bits
    and one row a step reach the driver.
    """
    spark = docs.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    dealt = docs.select("lang", "text", F.pmod(F.xxhash64("lang", "text", "_id"), F.lit(shards)).cast("int").alias("shard"),
                        F.hash("_id", F.monotonically_increasing_id()).bitwiseAND(0xFFFFFF).alias("key"))
    dealt.write.partitionBy("shard").parquet(f"{base}/texts")
    stored = spark.read.schema("lang string, text string, key int, shard int").parquet(f"{base}/texts")
    by_shard = [f"h{j}" for j in range(shards)]
    counts, step, known = None, 0, None
    while True:
        now = step % shards
        rows = scan(stored.where(F.col("shard") == now), known, step, step < shards, longest)
        rows = rows.select("h", "words", "hits", "since", F.col("check").alias("low"), F.col("check").alias("high"), "key", *[F.lit(0).cast("bigint").alias(c) for c in by_shard], F.lit(None).cast("int").alias("reached"))
        if counts is not None:
            rows = rows.unionByName(counts.select("*", F.lit(0).cast("bigint").alias("hits")))
        merged = rows.groupBy("h", "words").agg(F.sum("hits").alias("hits"), F.max("since").alias("since"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("key").alias("key"), *[F.max(c).alias(c) for c in by_shard], F.min("reached").alias("reached"))
        merged = merged.withColumn(by_shard[now], F.greatest("hits", by_shard[now])).drop("hits")
        enough = (sum((F.col(c) for c in by_shard[1:]), F.col(by_shard[0])) >= threshold) | (F.col("words") == 0)
        merged = merged.withColumn("reached", F.coalesce("reached", F.when(enough, F.lit(step))))
        # a written table cuts the lineage in a fifth of a checkpoint's bytes; the step before is no longer needed
        merged.where(F.col("reached").isNotNull() | (F.col("since") > step - shards + 1)).write.parquet(f"{base}/counts-{step}")
        counts = spark.read.schema(merged.schema).parquet(f"{base}/counts-{step}")
        remove_folder(spark, f"{base}/counts-{step - 1}")
        del rows, merged
        release_shuffles(spark)
        shorter = F.when(F.col("words").between(1, longest - 1) & (F.col("reached") > step - shards), True)
        state = counts.agg(F.count("reached").alias("n"), F.count(shorter).alias("open")).first()
        step += 1
        if known is not None:
            known.unpersist()
        known = spark.sparkContext.broadcast(phrase_filter(counts.where("reached is not null").select("h", "reached"), step, shards, state["n"]))
        if step >= shards and not state["open"]:
            break
    found = counts.where("reached is not null").select("h", "words", "low", "high", "key", sum((F.col(c) for c in by_shard[1:]), F.col(by_shard[0])).alias("hits"))
    alone = found.where(one_phrase())
    named = scan_names(stored.join(alone.groupBy("key").agg(F.collect_list("h").alias("wanted")), "key"), longest)
    named = named.groupBy("h", "words", "check").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))  # texts may share a key
    named = alone.withColumnRenamed("low", "check").join(named, ["h", "words", "check"]).select("lang", "phrase", "words", "hits")
    done = cut_lineage(named)
    kinds = found.agg(F.count("h").alias("n"), F.count(F.when(one_phrase(), True)).alias("alone")).first()
    if done.count() != kinds["alone"]:
        raise RuntimeError(f"{kinds['alone']} phrases counted, {done.count()} named")
    if n := kinds["n"] - kinds["alone"]:
        shared = found.where(~one_phrase()).select("h", F.lit(0).alias("reached"))
        only = spark.sparkContext.broadcast(phrase_filter(shared, step, shards, n))
        exact = scan_known(stored, known, longest, only).groupBy("lang", "phrase", "words").agg(F.sum("hits").alias("hits"))
        exact = exact.where((F.col("words") == 0) | (F.col("hits") >= threshold)).withColumn("phrase", F.coalesce("phrase", F.lit("")))
        # the filter also lets some through that have their hash to themselves
        done = cut_lineage(done.unionByName(exact.join(done, ["lang", "phrase"], "left_anti")))
        only.unpersist()
    known.unpersist()
    remove_folder(spark, base)
    return done


# ---------------------------------------------------------------- scores
def collocations(
    df: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2_000, cover_percent: int = 100, scale: int = 1_000, shards: int = SHARDS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Each language's ``top`` collocations of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at spaces and
    tabs into words.  Candidates occur at least ``threshold`` times.  A cut after the first ``k`` words
    scores ``floor(scale * a * n / (l * r))`` with the occurrences of the phrase, of all words, of
    the first and of the second part; the lowest cut counts (ties: the smallest ``k``).  A candidate goes
    if its words stand inside a longer candidate found at least ``cover_percent`` % as often.

    Returns ``lang, rank, phrase, a, l, r, n, score``: best score first, then the larger ``a``,
    then the phrase by bytes.  Null texts are empty, null languages ``und``; null and repeated ids and
    rows count like any other; empty tables and texts give no rows; other columns are ignored.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     F.col(id_col).alias("_id"))
    counted = frequent_phrases(docs, threshold, longest, shards)
    known = counted.where("words > 0")
    candidates = known.where("words > 1").select("lang", "phrase", "words", F.col("hits").alias("a"))
    hits = known.select("lang", "phrase", "hits")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(hits.select("lang", F.col("phrase").alias("left"), F.col("hits").alias("l")), ["lang", "left"])
    cuts = cuts.join(hits.select("lang", F.col("phrase").alias("right"), F.col("hits").alias("r")), ["lang", "right"])
    # a row for each language: joined like any table, broadcast by Spark if it is small
    cuts = cuts.join(counted.where("words = 0").select("lang", F.col("hits").alias("n")), "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", F.lit(scale).cast("decimal(10,0)") * (big("a") * big("n"))).withColumn("below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    inner = candidates.where("words > 2").select("lang", "words", F.col("a").alias("longer"), F.split("phrase", " ").alias("w"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("from", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("from"), F.col("size")), " ").alias("phrase"), "longer")
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # Spark keeps each task's first rows only
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
