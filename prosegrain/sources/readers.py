"""Documents from text files, Markdown, JSON records and tables. Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import FENCE, INLINE
from ..functions.text import LINE_END, lenient, normalise_lines, plain_words, split_text
from ..operators.resample import numbered
from ..operators.store import written

TEXT_FILES = ("*.txt",)
CHECK_FILES = ("*.md", "*.txt")


EXTENSION_FILES = ("*.txt", "*.md", "*.json", "*.jsonl")


def located(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(the full name that files below ``path`` begin with, whether it is a folder); a local path that is there is meant as such."""
    if "://" not in path and Path(path).exists():
        path = f"file://{Path(path).resolve()}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        raise ValueError(f"no such file or directory: {path}")
    status = fs.getFileStatus(at)
    return status.getPath().toString(), status.isDirectory()


def any_case(glob: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in glob)


def files(spark: SparkSession, path: str, globs: tuple[str, ...]) -> DataFrame:
    """(root, name, content), a row a file: those below a folder that fit a glob, by their place in it, or a single file of any name."""
    root, folder = located(spark, path)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if folder:
        rows = rows.option("pathGlobFilter", globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}")
    at = F.lit(root.rstrip("/"))
    name = F.substr("path", F.length(at) + 2) if folder else F.element_at(F.split("path", "/"), -1)
    return rows.load(root).select(F.lit(root).alias("root"), name.alias("name"), "content")


def some_files(spark: SparkSession, path: str, globs: tuple[str, ...]) -> DataFrame:
    """:func:`files`, of which there must be one."""
    rows = files(spark, path, globs)
    if not rows.select("name").limit(1).count():
        raise ValueError(f"no {' or '.join(g.lstrip('*') for g in globs)} file under {path}")
    return rows


def text_of(content: Column) -> Column:
    return normalise_lines(lenient(content))


def text_files(spark: SparkSession, path: str | list[str], globs: tuple[str, ...] = TEXT_FILES, keep_blank: bool = False) -> DataFrame:
    """(path, text), a row a file; line ends become ``\\n``, bytes that are no UTF-8 and files of white space only are left out.

    ``path`` is a file's name below its folder; of several folders, the folder's own name stands before it.
    """
    paths = [path] if isinstance(path, str) else list(path)
    out = None
    for p in paths:
        rows = some_files(spark, p, globs)
        name = F.concat_ws("/", F.element_at(F.split(F.lit(located(spark, p)[0]), "/"), -1), "name") if len(paths) > 1 and located(spark, p)[1] else F.col("name")
        rows = rows.select(name.alias("path"), text_of(F.col("content")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out if keep_blank else out.where(F.col("text").rlike(r"(?U)\S"))


def check_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of Markdown and text files, blank ones too; ``path`` is the name asked for and, in a folder, the file's place in it."""
    out = None
    for p in [path] if isinstance(path, str) else path:
        name = F.concat_ws("/", F.lit(p.rstrip("/")), "name") if located(spark, p)[1] else F.lit(p)
        rows = some_files(spark, p, CHECK_FILES).select(name.alias("path"), text_of(F.col("content")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def extension_files(spark: SparkSession, paths: list[str], split: str = "none", field: str = "text", keep_code: bool = False) -> DataFrame:
    """(path, text), a row a piece: of text and Markdown files by ``split``, of JSON and JSON lines every string under ``field``.

    Suffixes are read in either case. ``path`` is the file with the piece's number from 0. Markdown loses its code
    unless ``keep_code``. Lines of JSON that do not parse give nothing.
    """
    out = None
    for p in paths:
        base = p.rstrip("/")
        whole = F.concat_ws("/", F.lit(base), "name") if located(spark, p)[1] else F.lit(base)
        rows = some_files(spark, p, tuple(map(any_case, EXTENSION_FILES))).select(whole.alias("path"), text_of(F.col("content")).alias("text"), F.lower(F.element_at(F.split("name", r"\."), -1)).alias("kind"))
        prose = rows.where("kind NOT IN ('json', 'jsonl')").select("path", F.when((F.col("kind") == "md") & ~F.lit(keep_code), without_code(F.col("text"))).otherwise(F.col("text")).alias("text"))
        lines = F.when(F.col("kind") == "jsonl", F.split("text", LINE_END, -1)).otherwise(F.array("text"))
        records = rows.where("kind IN ('json', 'jsonl')").select("path", F.posexplode(lines).alias("line", "value"))
        texts = numbered(json_texts(records, field, "place"), ["path"], ["line", "place"])
        found = pieces(prose, split).union(texts.select(F.concat_ws("#", "path", F.col("idx").cast("string")).alias("path"), "text"))
        out = found if out is None else out.union(found)
    return out


def one_text(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(name, text)], "path string, text string")


def without_code(text: Column) -> Column:
    """Closed fences and inline code as one blank each: for profiles, where places do not matter."""
    closed = FENCE.replace(r"(?:\1|\z)", r"^[ \t]*\1")
    return F.regexp_replace(F.regexp_replace(text, closed, " "), INLINE, " ")


def pieces(docs: DataFrame, split: str = "none") -> DataFrame:
    """(path#n, text): the pieces of documents (path, text), numbered from 0."""
    rows = docs.select("path", F.posexplode(split_text(F.col("text"), split)).alias("k", "text"))
    return rows.select(F.concat_ws("#", "path", F.col("k").cast("string")).alias("path"), "text")


def json_texts(records: DataFrame, field: str = "text", place: str | None = None) -> DataFrame:
    """Every string under ``field`` in the JSON documents of column ``value``, at any depth.

    A column named ``place`` says where, if it is asked for: the places in lists and objects on the way; names of an
    object are in alphabetical order.

    An object whose field is a string gives it and is not searched further;
    other objects and lists are. Documents that are not JSON give nothing. Each
    level is written before the next is searched, until a level is empty, so
    the search reads every value once and ends at the deepest document's depth.
    """
    others = [c for c in records.columns if c != "value"]
    if place:
        records, others = records.withColumn(place, F.array().cast("array<int>")), [*others, place]
    now = records.select(*others, F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    found = None
    while True:
        held = F.try_variant_get("v", f"$.{field}", "variant")
        text = F.when(F.schema_of_variant("v").startswith("OBJECT") & (F.coalesce(F.schema_of_variant(held), F.lit("VOID")) == "STRING"), F.try_variant_get("v", f"$.{field}", "string"))
        open_ = F.when(text.isNull() & F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"), F.col("v"))
        level = written(now.select(*others, text.alias("text"), open_.alias("v")).where("text IS NOT NULL OR v IS NOT NULL"), "json-level")
        here = level.where("text IS NOT NULL").select(*others, "text")
        found = here if found is None else found.unionByName(here)
        rest = level.where("v IS NOT NULL").drop("text")
        if not rest.limit(1).count():
            return found
        each = records.sparkSession.tvf.variant_explode(F.col("v").outer())
        inner = rest.lateralJoin(each.select(F.col("pos").alias("at"), F.col("value").alias("part")))
        now = inner.select(*[F.concat(place, F.array("at")).alias(place) if c == place else c for c in others], F.col("part").alias("v"))


LEXICON_SCHEMA = T.StructType([
    T.StructField("meta", T.StringType()),
    T.StructField("jargon", T.MapType(T.StringType(), T.StructType([T.StructField(c, T.LongType()) for c in ("contrast_count", "approved_count")] + [T.StructField(c, T.DoubleType()) for c in ("log_likelihood", "log_ratio", "contrast_doc_share", "approved_doc_share", "zipf_en")]))),
    T.StructField("approved_vocabulary", T.MapType(T.StringType(), T.StructType([T.StructField("approved_count", T.LongType()), T.StructField("approved_doc_share", T.DoubleType()), T.StructField("source", T.StringType())]))),
])
EXTENSION_SCHEMA = T.StructType([T.StructField("meta", T.StringType()), T.StructField("vocabulary", T.MapType(T.StringType(), T.StructType([T.StructField("count", T.LongType()), T.StructField("doc_share", T.DoubleType())])))])


def _entries(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("term", "x")).select("term", "x.*")


def read_lexicon(spark: SparkSession, path: str):
    """A lexicon from one JSON document. Its stoplist counts as approved; a missing or zero gate is 5."""
    from ..operators.lexicon import Lexicon

    rows = spark.read.schema(LEXICON_SCHEMA).option("multiLine", True).json(path)
    meta = rows.select(F.coalesce(F.from_json(F.get_json_object("meta", "$.params.stoplist.terms"), "array<string>"), F.array().cast("array<string>")).alias("stop"),
                       F.get_json_object("meta", "$.params.zipf_gate").cast("double").alias("gate"), F.col("jargon").isNull().alias("none")).first()
    if meta is None or meta["none"]:
        raise ValueError(f"{path}: not a lexicon")
    approved = _entries(rows, "approved_vocabulary")
    if meta["stop"]:
        names = spark.createDataFrame([(s, 0, 0.0, "stoplist") for s in meta["stop"]], "term string, approved_count long, approved_doc_share double, source string")
        approved = approved.unionByName(names.join(approved.select("term"), "term", "left_anti"))
    return Lexicon(_entries(rows, "jargon"), approved, tuple(meta["stop"]), None, meta["gate"] or 5.0)


def read_extension(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, one row with the bar)"""
    rows = spark.read.schema(EXTENSION_SCHEMA).option("multiLine", True).json(path)
    bar = rows.select(F.coalesce(F.get_json_object("meta", "$.max_approved_dispersion").cast("double"), F.lit(1.0)).alias("max_approved_dispersion"))
    return _entries(rows, "vocabulary"), bar


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """(term): a term a line, in lower case; ``#`` opens a comment."""
    line = F.trim(F.lower(F.split_part("value", F.lit("#"), F.lit(1))))
    return spark.read.text(path).select(line.alias("term")).where("term <> ''").distinct()


def read_zipf(spark: SparkSession, path: str) -> DataFrame:
    """(term, zipf): a term and its frequency on the Zipf scale a line, by a tab, or a Parquet table of these columns."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("term", F.col("zipf").cast("double").alias("zipf"))
    return spark.read.option("sep", "\t").schema("term string, zipf double").csv(path).where("term IS NOT NULL AND zipf IS NOT NULL")


def calibration_files(spark: SparkSession, corpora: list[dict]) -> DataFrame:
    """(label, name, text, valid, words, sha256) of the ``.txt`` files of corpora (label, path), bytes read as they are.

    ``valid``: whether the bytes are UTF-8; the text of others is null. The digest is of the name, a zero byte and the bytes.
    """
    out = None
    for c in corpora:
        raw = F.col("content").cast("string")
        valid = F.is_valid_utf8(raw)
        digest = F.sha2(F.concat(F.encode("name", "UTF-8"), F.unhex(F.lit("00")), "content"), 256)
        rows = files(spark, c["path"], TEXT_FILES).select(F.lit(c["label"]).alias("label"), "name", F.when(valid, raw).alias("text"), valid.alias("valid"), digest.alias("sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("*", F.coalesce(plain_words(F.col("text")), F.lit(0)).cast("long").alias("words"))
