"""Term and document frequencies of corpora.

A corpus is a DataFrame with ``doc_id``, ``side`` and ``tokens``. Terms are counted
by lots of documents inside a task, so one shuffle of blocks of terms, with sums made
before it, yields both frequencies of all sides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.grams import LOT, blocks, coded, content, digests, distinct, distinct_coded, expanded, in_buckets, lots, pack, runs, squeezed, unpack
from ..functions.text import tokenize
from .store import written

#: Tokens of a lot whose terms are looked up: a row of about a megabyte.
LOOKED_UP = 250_000


def tokenized(docs: DataFrame, side: Column, text: Column | None = None) -> DataFrame:
    return docs.select("doc_id", side.alias("side"), tokenize(F.col("text") if text is None else text).alias("tokens"))


def term_counts(corpus: DataFrame, n_max: int = 3, sides: tuple[str, ...] = ("approved", "contrast")) -> DataFrame:
    """(term, tf_<side>, df_<side>, ...) over every term of any side.

    ``corpus`` may be in lots (:func:`in_lots`). A lot of documents is counted as numbers (:mod:`grams`); its distinct
    terms go on, once each, with their sums, in blocks by a digest of the term, and a block's bucket is added up at once.
    """
    names = [f"{c}_{s}" for s in sides for c in ("tf", "df")]
    laid = "codes" in corpus.columns

    def count(batches: Iterator) -> Iterator:
        for lot in lots(_read(batches) if laid else batches):
            own = [pc.fill_null(pc.equal(lot.column("side"), s), False).to_numpy(zero_copy_only=False) for s in sides]
            for f in distinct(lot.column("tokens"), range(1, n_max + 1)):
                sums = []
                for side in own:
                    here = side[f.row]
                    sums += [np.bincount(f.which[here], w, len(f.terms)).astype(np.int64) for w in (f.n[here], None)]
                yield _block_rows(blocks(f.terms, f.digest, np.array(sums)))

    def total(held: list) -> pa.Table:
        columns = [pa.concat_arrays([t for t, _ in held]), *[pa.array(x) for x in np.concatenate([x for _, x in held], 1)]]
        sums = pa.table(columns, ["term", *names]).group_by("term", use_threads=False).aggregate([(c, "sum") for c in names])
        return pa.table([sums.column("term"), *[sums.column(f"{c}_sum") for c in names]], ["term", *names])

    def add(batches: Iterator) -> Iterator:
        held, now = [], None
        for bucket, rows in runs(batches, "bucket"):
            if bucket != now and held:
                yield from total(held).to_batches()
                held = []
            now = bucket
            held += [unpack(x.as_py(), len(names)) for x in rows.column("block")]
        if held:
            yield from total(held).to_batches()

    rows = corpus.select(*(["sides", "tokens", "words", "codes"] if laid else ["side", "tokens"])).mapInArrow(count, "bucket int, block binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "term string, " + ", ".join(f"{c} long" for c in names))


def _codes(codes: bytes, lengths: np.ndarray) -> np.ndarray:
    n = int(lengths.sum())
    return np.frombuffer(expanded(codes, 4 * n), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)


def _read(batches: Iterator) -> Iterator:
    """Sides and tokens of lots."""
    for batch in batches:
        for sides, lengths, words, codes in zip(*(batch.column(c) for c in ("sides", "tokens", "words", "codes"))):
            own = lengths.values.to_numpy()
            tokens = unpack(words.as_py())[0].take(pa.array(_codes(codes.as_py(), own)))
            yield pa.RecordBatch.from_arrays([sides.values, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)).astype(np.int32)), tokens)], ["side", "tokens"])


def _block_rows(parts: Iterable, *more: tuple[str, pa.DataType, object]) -> pa.RecordBatch:
    parts = list(parts)
    fixed = [pa.array([value] * len(parts), kind) for _, kind, value in more]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), *fixed, pa.array([x for _, x in parts], pa.binary())], ["bucket", *[name for name, _, _ in more], "block"])


def unit_terms(units: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(unit, term, size, n): a row a distinct term of a unit (unit, tokens), which is one row."""

    def count(batches: Iterator) -> Iterator:
        for lot in lots(batches):
            for f in distinct(lot.column("tokens"), sizes):
                yield pa.RecordBatch.from_arrays([lot.column("unit").take(pa.array(f.row)), f.terms.take(pa.array(f.which)), pa.array(np.full(len(f.n), f.size, np.int32)), pa.array(f.n)], ["unit", "term", "size", "n"])

    unit = units.select("unit").schema[0]
    return units.select("unit", "tokens").mapInArrow(count, StructType([unit, StructField("term", StringType()), StructField("size", IntegerType()), StructField("n", LongType())]))


def in_lots(units: DataFrame) -> DataFrame:
    """(lot, units, sides, tokens, content, words, codes), written: a row for about ``LOOKED_UP`` tokens of units, with their ids,
    numbers of tokens and of content words, distinct words and the word of each token as a number; ``sides`` if units have a
    ``side``. Units in lots stay as they are."""
    if "codes" in units.columns:
        return units
    sided = [c for c in units.columns if c == "side"]

    def lay(batches: Iterator) -> Iterator:
        first = TaskContext.get().partitionId() << 32
        for k, lot in enumerate(lots(batches, LOOKED_UP)):
            words, code, lengths = coded(lot.column("tokens"))
            row = np.repeat(np.arange(len(lengths)), lengths)
            inside = np.bincount(row[content(words)[code]] if len(code) else row, minlength=len(lengths))
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            raw = code.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k], pa.int64()), listed(lot.column("unit")), *[listed(lot.column(c)) for c in sided], listed(pa.array(lengths, pa.int64())), listed(pa.array(inside, pa.int64())), pa.array([pack(words)], pa.binary()), pa.array([squeezed(raw)], pa.binary())],
                ["lot", "units", *[f"{c}s" for c in sided], "tokens", "content", "words", "codes"],
            )

    kind = units.select("unit").schema[0].dataType.simpleString()
    return written(units.select("unit", *sided, "tokens").mapInArrow(lay, f"lot long, units array<{kind}>, {'sides array<string>, ' if sided else ''}tokens array<long>, content array<long>, words binary, codes binary"), "unit-lots")


def lengths_of(laid: DataFrame) -> DataFrame:
    """(unit, tokens, content_words) of the units of :func:`in_lots`, a row a unit."""
    return laid.select(F.inline(F.arrays_zip(F.col("units").alias("unit"), F.col("tokens"), F.col("content").alias("content_words")))).toDF("unit", "tokens", "content_words")


def unit_terms(units: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(unit, term, size, n): a row a distinct term of a unit (unit, tokens), which is one row."""

    def count(batches: Iterator) -> Iterator:
        for lot in lots(batches, LOOKED_UP):
            for f in distinct(lot.column("tokens"), sizes):
                yield pa.RecordBatch.from_arrays([lot.column("unit").take(pa.array(f.row)), f.terms.take(pa.array(f.which)), pa.array(np.full(len(f.n), f.size, np.int32)), pa.array(f.n)], ["unit", "term", "size", "n"])

    unit = units.select("unit").schema[0]
    return units.select("unit", "tokens").mapInArrow(count, StructType([unit, StructField("term", StringType()), StructField("size", IntegerType()), StructField("n", LongType())]))


def known_terms(laid: DataFrame, known: DataFrame) -> DataFrame:
    """(unit, term, size, n, is_known): a row a distinct term of a unit; ``is_known``: the term, of one or two tokens, is in ``known`` (term).

    A lot's distinct terms go to the buckets of ``known``, and a bit for each comes back to the lot. Units stay where
    they are: no row of a unit's term is dealt out.
    """

    def terms(words: bytes, codes: bytes, lengths: np.ndarray, sizes: tuple[int, ...]) -> list:
        return list(distinct_coded(unpack(words)[0], _codes(codes, lengths), lengths, sizes))

    def ask(batches: Iterator) -> Iterator:
        for batch in batches:
            for lot, words, codes, lengths in zip(*(batch.column(c) for c in ("lot", "words", "codes", "tokens"))):
                if found := terms(words.as_py(), codes.as_py(), lengths.values.to_numpy(), (1, 2)):
                    yield _block_rows(blocks(pa.concat_arrays([f.terms for f in found]), np.concatenate([f.digest for f in found])), ("lot", pa.int64(), lot.as_py()))

    def offer(batches: Iterator) -> Iterator:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("term"))
            n += batch.num_rows
            if n >= LOOKED_UP:
                yield _block_rows(blocks(whole := pa.concat_arrays(held), digests(whole)[0]), ("lot", pa.int64(), -1))
                held, n = [], 0
        if n:
            yield _block_rows(blocks(whole := pa.concat_arrays(held), digests(whole)[0]), ("lot", pa.int64(), -1))

    def answered(bucket: int, known: pa.Array, asked: list) -> pa.RecordBatch:
        bits = pc.is_in(pa.concat_arrays([t for _, t in asked]), value_set=known).to_numpy(zero_copy_only=False)
        ends = np.cumsum([len(t) for _, t in asked])
        each = [np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([lot for lot, _ in asked], pa.int64()), pa.array([bucket] * len(asked), pa.int32()), pa.array([len(t) for _, t in asked], pa.int32()), pa.array(each, pa.binary())], ["lot", "bucket", "n", "bits"])

    def answer(batches: Iterator) -> Iterator:
        now, known, asked, n = None, [], [], 0
        for bucket, rows in runs(batches, "bucket"):
            if bucket != now or n >= LOT:
                if asked:
                    yield answered(now, pa.concat_arrays([pa.array([], pa.string()), *known]), asked)
                asked, n = [], 0
                known = known if bucket == now else []
                now = bucket
            for lot, block in zip(rows.column("lot").to_pylist(), rows.column("block")):
                part = unpack(block.as_py())[0]
                if lot < 0:
                    known.append(part)
                else:
                    asked.append((lot, part))
                    n += len(part)
        if asked:
            yield answered(now, pa.concat_arrays([pa.array([], pa.string()), *known]), asked)

    def tell(lot: dict, bits: list) -> Iterator:
        lengths = lot["tokens"].values.to_numpy()
        found = terms(lot["words"].as_py(), lot["codes"].as_py(), lengths, (1, 2, 3))
        short = [f for f in found if f.size < 3]
        yes = np.zeros(sum(len(f.terms) for f in short), bool)
        if short:
            yes[in_buckets(np.concatenate([f.digest for f in short]))[0]] = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for n, b in bits]).astype(bool)
        at = 0
        for f in found:
            own = np.zeros(len(f.terms), bool) if f.size > 2 else yes[at : at + len(f.terms)]
            at += len(f.terms)
            yield pa.RecordBatch.from_arrays([lot["units"].values.take(pa.array(f.row)), f.terms.take(pa.array(f.which)), pa.array(np.full(len(f.n), f.size, np.int32)), pa.array(f.n), pa.array(own[f.which])], ["unit", "term", "size", "n", "is_known"])

    def gather(batches: Iterator) -> Iterator:
        now, bits = None, []
        for _, rows in runs(batches, "lot"):
            buckets = rows.column("bucket").to_pylist()
            for k, bucket in enumerate(buckets):
                if bucket < 0:
                    if now is not None:
                        yield from tell(now, bits)
                    now, bits = {c: rows.column(c)[k] for c in ("units", "tokens", "words", "codes")}, []
                else:
                    bits.append((rows.column("n")[k].as_py(), rows.column("bits")[k].as_py()))
        if now is not None:
            yield from tell(now, bits)

    asked = laid.select("lot", "tokens", "words", "codes").mapInArrow(ask, "bucket int, lot long, block binary")
    offered = known.select("term").where("term IS NOT NULL").mapInArrow(offer, "bucket int, lot long, block binary")
    answers = asked.union(offered).repartition("bucket").sortWithinPartitions("bucket", "lot").mapInArrow(answer, "lot long, bucket int, n int, bits binary")
    rows = laid.select("lot", F.lit(-1).alias("bucket"), "units", "tokens", "words", "codes").unionByName(answers, allowMissingColumns=True)
    unit = StructField("unit", laid.schema["units"].dataType.elementType)
    schema = StructType([unit, StructField("term", StringType()), StructField("size", IntegerType()), StructField("n", LongType()), StructField("is_known", BooleanType())])
    return rows.repartition("lot").sortWithinPartitions("lot", "bucket").mapInArrow(gather, schema)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """(side, docs, tokens, median_tokens): the upper median of the documents' lengths.

    The median comes from counts by length, of which there are few.
    """
    rows = corpus.select(F.inline(F.arrays_zip(F.col("sides").alias("side"), F.col("tokens").alias("n")))).toDF("side", "n") if "codes" in corpus.columns else corpus.select("side", F.size("tokens").alias("n"))
    by_length = rows.groupBy("side", "n").agg(F.count("*").alias("docs"))
    run = W.partitionBy("side").orderBy("n")
    everything = W.partitionBy("side")
    ranked = by_length.withColumn("upto", F.sum("docs").over(run)).withColumn("all", F.sum("docs").over(everything))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n")))
    return ranked.groupBy("side").agg(F.sum("docs").cast("long").alias("docs"), F.sum(F.col("n") * F.col("docs")).cast("long").alias("tokens"), middle.cast("long").alias("median_tokens"))


def scaled_share(median: Column, docs: Column, base: float, low: float, high: float, least_docs: int) -> Column:
    """A bar on the share of documents, scaled by their median length and never under ``least_docs`` documents."""
    p = F.greatest(F.lit(low), F.least(F.lit(high), base * median / 250))
    return F.bround(F.greatest(p, least_docs / F.greatest(docs, F.lit(1))), 4)


def log_likelihood(o1: Column, n1: Column, o2: Column, n2: Column) -> Column:
    """Dunning's G2 of two counts in two corpora; a zero count adds nothing."""
    both, size = o1 + o2, n1 + n2
    e1, e2 = n1 * both / size, n2 * both / size
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (part(o1, e1) + part(o2, e2))


def log_ratio(o1: Column, n1: Column, o2: Column, n2: Column) -> Column:
    """Binary log of the ratio of relative frequencies, a zero count taken as a half."""
    half = lambda o: F.when(o > 0, o.cast("double")).otherwise(0.5)
    return F.log2((half(o1) / n1) / (half(o2) / n2))
