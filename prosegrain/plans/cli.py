"""Command line: ``python -m prosegrain.plans.cli COMMAND ...``. Exit 0: clean; 1: findings; 2: wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterable, Iterator
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import bands as B
from ..operators import lexicon as L
from ..operators import parse_rules as P
from ..operators import rules as R
from ..operators import score as S
from ..operators.store import purge, written
from ..operators.terms import tokenized
from ..sources import readers, writers
from . import band_tables, calibration, documents, settings

#: Tokens a side under which keyness says little.
FEW_TOKENS = 30_000


def session() -> SparkSession:
    return SparkSession.builder.appName("prosegrain").getOrCreate()


def say(*lines: str) -> None:
    for line in lines:
        print(line, file=sys.stderr)


# --- lexicons ---------------------------------------------------------------


def _corpus(spark: SparkSession, approved: str, contrast: str) -> DataFrame:
    side = lambda path, name: tokenized(readers.text_files(spark, path.split(",")).withColumnRenamed("path", "doc_id"), F.lit(name))
    return side(approved, "approved").unionByName(side(contrast, "contrast"))


def build(a: argparse.Namespace) -> int:
    spark = session()
    stop = tuple(r[0] for r in readers.read_stoplist(spark, a.stoplist).collect()) if a.stoplist else ()
    given = L.Settings(a.min_contrast_count, a.min_approved_count, a.ll, a.lr, a.min_contrast_dispersion, a.max_approved_dispersion, a.zipf_gate)
    corpus = _corpus(spark, a.approved, a.contrast)
    made = L.build(corpus, given, stop, readers.read_zipf(spark, a.zipf) if a.zipf else None)
    writers.write_lexicon_tables(made, a.output)
    print(f"{made.jargon.count()} jargon terms, {made.approved.count()} approved terms")
    for r in made.jargon.orderBy(F.desc("log_likelihood"), "term").limit(15).collect():
        print(f"{r.log_likelihood:>10} {r.log_ratio:>6} {r.term}")
    for r in corpus.groupBy("side").agg(F.sum(F.size("tokens")).alias("n")).orderBy("side").collect():
        if r.n < FEW_TOKENS:
            say(f"warning: {r.n} tokens on the {r.side} side; under {FEW_TOKENS} keyness says little")
    return 0


def _lexicon_named(name: str) -> str | None:
    """A path, or a name in the folders of lexicons: a JSON document or a folder of tables."""
    if "://" in name or Path(name).exists():
        return name
    if settings.NAME.match(name):
        for folder in documents.scopes("lexicons").values():
            for at in (folder / f"{name}.json", folder / name):
                if at.exists():
                    return str(at)
    return None


def _lexicon(spark: SparkSession, name: str) -> L.Lexicon:
    path = _lexicon_named(name)
    if path is None:
        raise ValueError(f"no lexicon named {name!r}")
    return readers.read_lexicon(spark, path) if path.endswith(".json") else writers.read_lexicon_tables(spark, path)


def _extensions() -> dict[str, Path]:
    out: dict[str, Path] = {}
    for folder in documents.scopes("extensions").values():
        for at in sorted(folder.iterdir()) if folder.is_dir() else ():
            out.setdefault(at.name.removesuffix(".json"), at)
    return out


def _extension(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame, dict]:
    """(vocabulary, bar, what is known of it) of a path or a name."""
    at = Path(name) if Path(name).exists() else _extensions().get(name)
    if at is None:
        raise ValueError(f"no extension named {name!r}; there is {', '.join(_extensions()) or 'none'}")
    if at.suffix == ".json":
        return *readers.read_extension(spark, str(at)), json.loads(at.read_text(encoding="utf-8")).get("meta") or {}
    meta = json.loads((at / "meta.json").read_text(encoding="utf-8"))
    return spark.read.parquet(str(at / "vocabulary")), spark.createDataFrame([(float(meta["max_approved_dispersion"]),)], "max_approved_dispersion double"), meta


def _extended(spark: SparkSession, lexicon: L.Lexicon, names: Iterable[str]) -> L.Lexicon:
    for name in names:
        vocabulary, bar, _ = _extension(spark, name)
        vetoed, new = L.vetoed(lexicon.jargon, vocabulary, bar).count(), vocabulary.join(lexicon.approved.select("term"), "term", "left_anti").count()
        say(f"extend: {name} ({vetoed} vetoed, {new} added)")
        lexicon = L.extend(lexicon, vocabulary, bar)
    return lexicon


def extend(a: argparse.Namespace) -> int:
    """Profile one more approved corpus, as a folder of a table and a document, found by name."""
    if not settings.NAME.match(a.name):
        raise ValueError(f"bad name {a.name!r}: small letters, digits, full stops, underscores and hyphens")
    spark = session()
    paths = [p for p in a.paths if p != "-"]
    docs = readers.extension_files(spark, paths, a.split, a.field, a.keep_code) if paths else None
    if "-" in a.paths:
        more = readers.pieces(readers.one_text(spark, sys.stdin.read()), a.split)
        docs = more if docs is None else docs.unionByName(more)
    tokens = written(docs.select(F.col("path").alias("doc_id"), tokenize(F.col("text")).alias("tokens")), "extension")
    vocabulary, meta = L.profile(tokens)
    m = meta.first()
    if m is None or not m.docs:
        raise ValueError("no document of three tokens or more; look at --split and --field")
    dropped = tokens.count() - m.docs
    folder = Path.home() / documents.OWN / "extensions" / a.name
    vocabulary.write.mode("overwrite").parquet(str(folder / "vocabulary"))
    terms = spark.read.parquet(str(folder / "vocabulary")).count()
    known = {**m.asDict(), "name": a.name, "sources": a.paths, "built": date.today().isoformat(), "options": {"split": a.split, "field": a.field, "keep_code": a.keep_code}, "note": a.note, "terms": terms}
    settings.write_json(folder / "meta.json", known)
    print(f"{a.name}: {m.docs} docs, {m.tokens:,} tokens, median doc {m.median_doc_tokens} tokens" + (f" ({dropped} of under three tokens left out)" if dropped else ""))
    print(f"vocabulary: {terms:,} terms; a term vetoes jargon above {m.max_approved_dispersion:.1%} of docs")
    if m.tokens < FEW_TOKENS:
        say(f"warning: under {FEW_TOKENS} tokens the veto misses terms that are in use")
    bar = spark.createDataFrame([(float(m.max_approved_dispersion),)], "max_approved_dispersion double")
    for surface in calibration.SURFACES:
        if at := _lexicon_named(f"universal-{surface}"):
            lexicon = _lexicon(spark, at)
            gone = L.vetoed(lexicon.jargon, spark.read.parquet(str(folder / "vocabulary")), bar)
            first = [r.term for r in gone.orderBy(F.desc("log_likelihood"), "term").limit(8).collect()]
            print(f"  universal-{surface:<14} vetoes {gone.count():>3} of {lexicon.jargon.count():>3} jargon terms" + (f": {', '.join(first)}" if first else ""))
    print(f"extension written to {folder}")
    return 0


def extensions(a: argparse.Namespace) -> int:
    found = _extensions()
    if not found:
        say("no extensions; make one with extend NAME PATH...")
        return 0
    print(f"{'extension':<24} {'docs':>6} {'tokens':>9} {'terms':>6}  note")
    spark = session()
    for name in found:
        vocabulary, _, m = _extension(spark, name)
        print(f"{name:<24} {m.get('docs', 0):>6} {m.get('tokens', 0):>9,} {m.get('terms') or vocabulary.count():>6}  {m.get('note') or ''}")
    return 0


# --- scores and comparison --------------------------------------------------


def _units(spark: SparkSession, path: str) -> DataFrame:
    return readers.text_files(spark, path.split(",")).select(F.col("path").alias("unit"), tokenize(F.col("text")).alias("tokens"))


def _sentences(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.text import scored_sentences

    rows = readers.text_files(spark, path, keep_blank=True).select(F.posexplode(scored_sentences(F.col("text"))).alias("k", "sentence"))
    return rows.select(F.col("k").cast("string").alias("unit"), "sentence", tokenize(F.col("sentence")).alias("tokens"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    return readers.located(spark, path.split(",")[0])[1]


def _listed(head: str, terms: list, with_docs: bool) -> list[str]:
    return [head, *(f"  {t.term:<28} x{t.hits}" + (f" in {t.docs} docs" if with_docs else "") for t in terms)] if terms else []


def score(a: argparse.Namespace) -> int:
    spark = session()
    lexicon = _extended(spark, _lexicon(spark, a.lexicon), a.extend)
    if not _is_folder(spark, a.target):
        return _score_file(spark, a, lexicon)
    units = written(_units(spark, a.target), "units")
    r = S.corpus_report(units, lexicon).first()
    rows = S.file_rows(units, lexicon).orderBy(F.desc("jargon_density_per_1k"), "unit")
    if a.json:
        # The rows of files go out one after another; the driver holds a part of them.
        fields = ("docs", "tokens", "content_words", *[f"{c}_hits" for c in S.CLASSES], *[f"{c}_density_per_1k" for c in S.CLASSES], "approved_coverage", *[f"docs_with_{c}" for c in S.CLASSES])
        head = {"dir": a.target, **{f: r[f] for f in fields}, "top_flagged": [[t.term, t.hits] for t in r.top_jargon]}
        head |= {f"top_{c}s": [[t.term, t.docs, t.hits] for t in r[f"top_{c}"]] for c in S.CLASSES[1:]}
        _stream(sys.stdout, head, "files", ({"file": x.unit, **{k: v for k, v in x.asDict().items() if k != "unit"}} for x in rows.toLocalIterator()))
        return 0
    print(f"{a.target}: {r.docs} docs, {r.tokens:,} tokens, {r.content_words:,} content words")
    print(f"jargon density: {r.jargon_density_per_1k} per 1,000 content words   unapproved unigrams: {r.unapproved_unigram_density_per_1k}   unapproved bigrams: {r.unapproved_bigram_density_per_1k}   approved coverage: {r.approved_coverage:.0%}   docs with jargon: {r.docs_with_jargon}/{r.docs}")
    for line in [*_listed("top flagged terms:", r.top_jargon, False), *_listed("top unapproved unigrams:", r.top_unapproved_unigram, True), *_listed("top unapproved bigrams:", r.top_unapproved_bigram, True)]:
        print(line)
    print(f"{'file':<44} {'tokens':>6} {'jarg/1k':>8} {'unap/1k':>8} {'coverage':>8}  top terms | top unapproved")
    for x in rows.limit(a.top).collect():
        print(f"{x.unit[:44]:<44} {x.tokens:>6} {x.jargon_density_per_1k:>8} {x.unapproved_unigram_density_per_1k:>8} {x.approved_coverage:>8.0%}  {', '.join(x.top_terms)} | {', '.join(x.top_unapproved)}")
    if r.docs > a.top:
        print(f"... {r.docs - a.top} more files (--top N or --json)")
    return 0


def _score_file(spark: SparkSession, a: argparse.Namespace, lexicon: L.Lexicon) -> int:
    units = readers.text_files(spark, a.target, keep_blank=True).select(F.col("path").alias("unit"), tokenize(F.col("text")).alias("tokens"))
    hits = written(S.term_hits(units, lexicon), "hits")
    x = S.score(units, lexicon, hits).first()
    terms = hits.where("class IS NOT NULL").orderBy(F.desc("n"), "term").collect()  # of one file
    flagged = {t.term: {"count": t.n, "log_ratio": t.log_ratio, "approved_count": t.approved_count} for t in terms if t["class"] == "jargon"}
    others = {c: {t.term: t.n for t in terms if t["class"] == c} for c in S.CLASSES[1:]}
    sentences = S.sentence_report(_sentences(spark, a.target), lexicon).orderBy(F.col("unit").cast("int")).collect()
    if a.json:
        print(json.dumps({k: v for k, v in x.asDict().items() if k != "unit"} | {"flagged": flagged, **{f"{c}s": v for c, v in others.items()}, "sentences_with_jargon": [{"sentence": s.sentence, "terms": s.terms, "unapproved": s.unapproved} for s in sentences]}, indent=1, ensure_ascii=False))
        return 0
    print(f"content words: {x.content_words} of {x.tokens} tokens")
    for name, value in (("jargon density", x.jargon_density_per_1k), ("unapproved unigrams", x.unapproved_unigram_density_per_1k), ("unapproved bigrams", x.unapproved_bigram_density_per_1k)):
        print(f"{name}: {value} per 1,000 content words")
    print(f"approved coverage: {x.approved_coverage:.0%} of content words")
    for t, s in flagged.items():
        print(f"  {t:<28} x{s['count']}  (approved corpus: {s['approved_count']} times)")
    for c, found in others.items():
        for t, n in found.items():
            print(f"  {c.replace('_', ' ')}: {t:<28} x{n}")
    for s in sentences:
        print(f'  -> {s.terms} + unapproved {s.unapproved}: "{s.sentence}"')
    return 0


#: Names of the classes in a comparison's document and in text.
COMPARED = {"jargon": ("jargon", "jargon"), "unapproved_unigram": ("unapproved_unigrams", "unapproved unigrams"), "unapproved_bigram": ("unapproved_bigrams", "unapproved bigrams")}


def delta(a: argparse.Namespace) -> int:
    """Folders are compared by documents, files by sentences."""
    spark = session()
    lexicon = _extended(spark, _lexicon(spark, a.lexicon), a.extend)
    folder = _is_folder(spark, a.first)
    units, n = None, {}
    for side, path in (("a", a.first), ("b", a.second)):
        own = written(_units(spark, path) if _is_folder(spark, path) else _sentences(spark, path).select("unit", "tokens"), "units")
        n[side] = own.count()
        s = S.score(own, lexicon).withColumn("side", F.lit(side))
        units = s if units is None else units.unionByName(s)
    rows = {r["class"]: r for r in S.delta(units, a.boot, exact=True).collect()}
    unit = "documents" if folder else "sentences"
    if a.json:
        each = {COMPARED[c][0]: {"a_density": r.a_density, "b_density": r.b_density, "delta": r.delta, "ci95": [r.ci_low, r.ci_high], "credible": r.credible} for c, r in rows.items()}
        print(json.dumps({"unit": unit, "a": {"path": a.first, "units": n["a"]}, "b": {"path": a.second, "units": n["b"]}, **each}, indent=1))
        return 0
    print(f"A: {a.first}  ({n['a']} {unit})\nB: {a.second}  ({n['b']} {unit})")
    for c in S.CLASSES:
        r = rows[c]
        print(f"{COMPARED[c][1]} (A - B): {r.delta:+.2f} per 1,000 content words, A {r.a_density} vs B {r.b_density}, 95% bootstrap CI [{r.ci_low:+.2f}, {r.ci_high:+.2f}]: {'credible' if r.credible else 'noise'}")
    return 0


# --- checks -----------------------------------------------------------------


def _stream(out, head: dict, name: str, items: Iterator[dict]) -> None:
    """One JSON document whose last field is a list, written item by item."""
    text = json.dumps(head, ensure_ascii=False)
    out.write(text[:-1] + (", " if head else "") + json.dumps(name) + ": [")
    for k, item in enumerate(items):
        out.write((", " if k else "") + "\n" + json.dumps(item, ensure_ascii=False))
    out.write("]}\n")


def _verdict_lines(rows: list, words: int, table: dict) -> list[str]:
    name = table["name"]
    if words < B.MIN_WORDS:
        return [f"bands {name}: too few words ({words}, {B.MIN_WORDS} are needed), so nothing is compared"]
    line = lambda r: " · ".join([f"  {r.rule}  {band_tables.number(r.rate_per_1k)}/1k", *band_tables.parts(table["rules"][r.rule])]) + f" -> {r.status}" + ("" if r.status == "PASS" else f" · {r.position}")
    return [f"band summary (bands: {name}, {words:,} words):", *map(line, rows)]


def _band_data(rows: list, words: int, table: dict, scope: str) -> dict:
    out = {"bands": table["name"], "scope": scope, "words": words, "available": True, "rules": {}}
    if words < B.MIN_WORDS:
        return out | {"guard": "small-sample"}
    for r in rows:
        e = table["rules"][r.rule]
        out["rules"][r.rule] = {"rate_per_1k": r.rate_per_1k, "status": r.status, "position": r.position, "direction": r.direction, **{k: e.get(k) for k in ("human_universal", "human_internal", "ai_universal", "ai_internal")}}
    return out


def _notes(spark: SparkSession, docs: DataFrame, lexicon: L.Lexicon) -> Iterator[str]:
    """What W-M10 says of each document, then of the run; it is no finding."""
    units = docs.select(F.col("path").alias("unit"), tokenize(F.col("text")).alias("tokens"))
    hits = written(S.term_hits(units, lexicon), "hits")
    scores = written(S.score(units, lexicon, hits), "scores")
    kinds = ("unapproved_unigram", "unapproved_bigram")
    tops = None
    for kind in kinds:
        pairs = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term", "hits"))), lambda x: F.concat(x["term"], F.lit("×"), x["hits"].cast("string")))
        each = S.top_of_each(hits, kind, 5).groupBy(F.col("unit").alias("u")).agg(F.array_join(pairs, ", ").alias(kind))
        tops = each if tops is None else tops.join(each, "u", "full")
    for r in scores.join(tops, F.col("unit") == F.col("u"), "left").orderBy("unit").toLocalIterator():
        yield f"note: {r.unit}: jargon density {r.jargon_density_per_1k}, unapproved unigrams {r.unapproved_unigram_density_per_1k}, unapproved bigrams {r.unapproved_bigram_density_per_1k} per 1,000 content words, approved coverage {r.approved_coverage:.0%}"
        for kind in kinds:
            if r[kind]:
                yield f"note: {r.unit}: {kind.replace('_', ' ')}s: {r[kind]}"
    yield from (r.value for r in S.advisory(scores, hits).collect())


def check(a: argparse.Namespace) -> int:
    spark = session()
    missing = [p for p in a.paths if p != "-" and "://" not in p and not Path(p).exists()]
    if missing:
        raise ValueError(f"no such file or directory: {', '.join(missing)}")
    config = documents.config()
    named = a.voice or config.get("voice", (None,))[0]
    voice, scope, at = documents.voice(named) if named else (None, "", None)
    if voice:
        say(f"voice: {voice['name']} ({scope}{', from the configuration' if not a.voice else ''})")
    fields = settings.pairs(a.field)
    flags = {"rules": a.rules, "bands": a.bands, "lexicon": a.lexicon, "fields": fields, "extend": a.extend}
    parser_there = P.available() and not a.no_parser
    plan = settings.resolve(flags, voice, {k: v[0] for k, v in config.items()}, parser_there)
    asked = a.bands or (voice or {}).get("bands") or config.get("bands", (None,))[0]
    table, found_in = None, ""
    if plan.bands:
        try:
            table, found_in = band_tables.named(plan.bands, band_scopes())
        except ValueError as e:
            if asked:
                raise
            say(f"bands: {e}, which the rule set implies")
    lexicon = None
    if plan.lexicon and (_lexicon_named(plan.lexicon) or a.lexicon or (voice or {}).get("lexicon")):
        lexicon = _lexicon(spark, plan.lexicon)
        if not a.lexicon:
            say(f"lexicon: {plan.lexicon} ({'voice' if (voice or {}).get('lexicon') else 'by the bands'}; --lexicon overrides)")
    if plan.extend:
        if lexicon is None:
            raise ValueError("extensions need a lexicon: name bands or a lexicon")
        lexicon = _extended(spark, lexicon, plan.extend)
    run = [r for r in plan.rules if r != "W-M10" or lexicon is not None]
    skipped = sorted({*plan.skipped, *({"W-M10"} & set(plan.rules) - set(run))}, key=R.rule_order)
    parsed = [r for r in run if r in R.PARSED]
    if any(r in R.PARSED for r in skipped) and not a.no_parser:
        say("warning: spaCy is not installed, so rules that need a parse do not run")

    paths = [p for p in a.paths if p != "-"]
    docs = readers.check_files(spark, paths) if paths else None
    if not a.paths or "-" in a.paths:
        typed = readers.one_text(spark, sys.stdin.read())
        docs = typed if docs is None else docs.unionByName(typed)
    docs = written(docs, "documents")
    found = R.check(docs, [r for r in run if r != "W-M10"], fields)
    if parsed:
        tokens = written(P.parse(docs), "tokens")
        own = [r for r in parsed if r in P.PARSE_RULES]
        found = found.unionByName(P.check_parsed(tokens, own)) if own else found
        found = found.unionByName(P.non_imperative(written(P.parse_items(docs), "items"))) if "T-M10" in parsed else found
    found = written(found, "findings")  # counted, compared and sorted, computed once
    counts = {r.rule: r.findings for r in B.finding_counts(found).collect()}  # a row a rule
    words = docs.agg(F.coalesce(F.sum(F.size(tokenize(F.col("text")))), F.lit(0)).alias("words"))
    n = words.first()["words"]
    if lexicon is not None and "W-M10" in run:
        say(*_notes(spark, docs, lexicon))
    say(*[f"skipped: {r}" for r in skipped])
    total = sum(counts.values())
    say(f"checked {len(run)} rules over {n:,} words: {total} findings" + (f" ({len(skipped)} skipped: {', '.join(skipped)})" if skipped else ""))
    data: dict = {"bands": None, "available": False}
    lines = ["bands: name a table with --bands to compare (bands list)"]
    if table:
        rows = B.verdicts(B.finding_counts(found), words, band_tables.frame(spark, table), [r for r in ("W-M1",) if r in run]).orderBy("rule").collect()
        data, lines = _band_data(rows, n, table, found_in), _verdict_lines(rows, n, table)
    _put_report(a, docs, found, {
        "rules": a.rules or (voice["name"] if voice else "westinghouse"), "rules_run": run, "tiers_run": ["1", "1b", *(["2"] if parsed else [])], "rules_skipped": skipped,
        "counts": {"findings": total, "rules_checked": len(run)}, "by_rule": dict(sorted(counts.items())), "bands": data, **({"voice": {"name": voice["name"], "scope": scope, "path": str(at)}} if voice else {}),
    })
    if not a.json:
        say(*lines)
    return int(total > 0)


def _put_report(a: argparse.Namespace, docs: DataFrame, found: DataFrame, head: dict) -> None:
    """On the screen or in a file: one document or a line a finding, row by row. An output without suffix is a folder that Spark writes."""
    if a.output and not Path(a.output).suffix:
        (writers.write_findings_json if a.json else writers.write_findings_text)(found, a.output)
        return
    out = open(a.output, "w", encoding="utf-8") if a.output else sys.stdout  # noqa: SIM115
    try:
        if a.json:
            head = {"paths": [r.path for r in docs.select("path").orderBy("path").toLocalIterator()], **head}
            each = R.sort_findings(found).select("rule", "path", "line", "label", "match", "fix")
            _stream(out, head, "findings", ({k: v for k, v in r.asDict().items() if v is not None} for r in each.toLocalIterator()))
        else:
            for line in R.finding_line(R.sort_findings(found)).toLocalIterator():
                out.write(line[0] + "\n")
    finally:
        if a.output:
            out.close()


# --- bands, voices, configuration -------------------------------------------


def band_scopes() -> dict[str, Path]:
    return documents.scopes("bands")


def bands(a: argparse.Namespace) -> int:
    if a.what == "list":
        print("\n".join(band_tables.listing(band_scopes())))
    elif a.what == "schema":
        print(json.dumps(band_tables.SCHEMA, indent=2))
    else:
        print("\n".join(band_tables.lines(*band_tables.named(a.name or "", band_scopes()))))
    return 0


def _given(path: str | None) -> dict:
    doc = json.loads(sys.stdin.read() if path in (None, "-") else Path(path).read_text(encoding="utf-8"))
    if not isinstance(doc, dict):
        raise ValueError("a JSON object is wanted")
    return doc


def voice(a: argparse.Namespace) -> int:
    """``voice new|list|rubric|set|rm|schema``."""
    folders = documents.scopes("voices")
    if a.what == "schema":
        print(json.dumps(documents.VOICE, indent=2))
    elif a.what == "list":
        lines = documents.voice_listing()
        print("\n".join(lines)) if lines else say("no voices; make one with voice new NAME FILE")
    elif a.what == "new":
        doc = _given(a.rest[0] if a.rest else None)
        doc.setdefault("name", a.name)
        if a.checks and "checks" not in doc:
            doc["checks"] = [*R.select(a.checks, True, True, True)[0]]
        at = folders["project" if a.project else "personal"] / f"{a.name}.json"
        if not settings.NAME.match(a.name or "") or doc["name"] != a.name:
            raise ValueError(f"the document's name {doc['name']!r} and the command's {a.name!r} must be one good name")
        if at.exists() and not a.force:
            raise ValueError(f"{at} is there already; --force overwrites it")
        documents.save_voice(at, doc)
        print(at)
    else:
        doc, scope, at = documents.voice(a.name or "")
        if a.what == "rubric":
            print(json.dumps(doc, indent=2, ensure_ascii=False) if a.json else settings.rubric_text(doc, scope))
        elif a.what == "rm":
            at.unlink()
            print(f"removed {at} ({scope})")
        else:
            if a.rest and a.rest[0] in settings.LISTS + settings.SCALARS:
                edited = settings.edited_voice(doc, a.rest[0], a.rest[1:])
            else:
                patch = _given(a.rest[0] if a.rest else None)
                if patch.get("name", doc["name"]) != doc["name"]:
                    raise ValueError("a voice keeps its name; make a new one")
                edited = settings.merged_voice(doc, patch)
            documents.save_voice(at, edited)
            print(at)
    return 0


def config(a: argparse.Namespace) -> int:
    if a.what == "schema":
        print(json.dumps(documents.CONFIG, indent=2))
        return 0
    found = documents.config()
    for scope in ("personal", "project"):
        print(f"{scope}: {next((path for _, s, path in found.values() if s == scope), 'none')}")
    for field, (value, scope, _) in found.items():
        print(f"{field:<8} {', '.join(value) if isinstance(value, list) else value}  ({scope})")
    return 0


def calibrate(a: argparse.Namespace) -> int:
    run, new = calibration.calibrate(session(), a.manifest, a.output, a.reuse)
    print(f"{len(run['corpora'])} corpora, {len(new)} counted anew; the bands to review are in {a.output}/bands")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="prosegrain")
    sub = top.add_subparsers(required=True)

    def command(name: str, run) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        return p

    p = command("build", build)
    p.add_argument("approved"), p.add_argument("contrast"), p.add_argument("-o", "--output", required=True), p.add_argument("--stoplist", default=""), p.add_argument("--zipf", default="")
    for flag, kind, default in (("--min-contrast-count", int, 5), ("--min-approved-count", int, 3), ("--ll", float, 15.13), ("--lr", float, 2.0), ("--min-contrast-dispersion", float, None), ("--max-approved-dispersion", float, None), ("--zipf-gate", float, 5.0)):
        p.add_argument(flag, type=kind, default=default)
    p = command("extend", extend)
    p.add_argument("name"), p.add_argument("paths", nargs="+"), p.add_argument("--split", choices=["none", "blank", "line"], default="none"), p.add_argument("--field", default="text"), p.add_argument("--keep-code", action="store_true"), p.add_argument("--note", default="")
    command("extensions", extensions)
    p = command("score", score)
    p.add_argument("target"), p.add_argument("-l", "--lexicon", required=True), p.add_argument("--extend", action="append", default=[]), p.add_argument("--top", type=int, default=20), p.add_argument("--json", action="store_true")
    p = command("delta", delta)
    p.add_argument("first"), p.add_argument("second"), p.add_argument("-l", "--lexicon", required=True), p.add_argument("--extend", action="append", default=[]), p.add_argument("--boot", type=int, default=2000), p.add_argument("--json", action="store_true")
    p = command("check", check)
    p.add_argument("paths", nargs="*"), p.add_argument("--rules"), p.add_argument("--bands", "--surface"), p.add_argument("--voice"), p.add_argument("--lexicon"), p.add_argument("--extend", action="append", default=[]), p.add_argument("--field", action="append", default=[])
    p.add_argument("--json", action="store_true"), p.add_argument("--no-parser", action="store_true"), p.add_argument("-o", "--output")
    p = command("calibrate", calibrate)
    p.add_argument("--manifest", required=True), p.add_argument("--output", required=True), p.add_argument("--reuse")
    p = command("bands", bands)
    p.add_argument("what", choices=["list", "show", "schema"]), p.add_argument("name", nargs="?")
    p = command("voice", voice)
    p.add_argument("what", choices=["new", "list", "rubric", "set", "rm", "schema"]), p.add_argument("name", nargs="?"), p.add_argument("rest", nargs="*"), p.add_argument("--project", action="store_true"), p.add_argument("--force", action="store_true"), p.add_argument("--checks"), p.add_argument("--json", action="store_true")
    p = command("config", config)
    p.add_argument("what", choices=["show", "schema"])
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except (ValueError, OSError) as e:
        say(f"error: {e}")
        return 2


if __name__ == "__main__":
    code = main()
    if (active := SparkSession.getActiveSession()) is not None:
        purge(active)
    sys.exit(code)
