"""All queries of the library outside the subpackage for text corpora, and their SQL.

Queries on `spans` take each delivered span once; those on `scores` the score loaded last of each line. Whole numbers are longs on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noteforge.functions import text as tx
from noteforge.functions.layout import spread
from noteforge.operators import alignment, calibration, chunks, lines, metrics, rejects, rules, spans
from noteforge.operators.router import LineRouter, RouterConfig
from noteforge.plans.pipeline import Deidentifier
from noteforge.sources.annotations import refined_tokens

BALANCED = 0.21
DIMENSION = 131072
GROUPS = {"contact": ["ADRESSE", "MAIL", "TEL"], "names": ["NOM", "PRENOM"]}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for work that is heavy by the row."""
    return spread(_read(spark, folder, "documents"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", "text")


def _spans(spark: SparkSession, folder: str, source: int | None = None) -> DataFrame:
    valid = spans.valid_spans(_read(spark, folder, "spans")).select("doc_id", "span_start", "span_end", "label", F.col("source").cast("int").alias("source"))
    return valid if source is None else valid.where(F.col("source") == source)


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return spans.gold_spans(_read(spark, folder, "documents"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return lines.latest_scores(_read(spark, folder, "scores"))


def _longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def p5_found(spark, folder):
    return rejects.rejected(_read(spark, folder, "raw_rows"))


def p5_loaded_notes(spark, folder):
    notes = rejects.loaded_notes(rejects.decode(_read(spark, folder, "raw_rows")))
    return notes.select("row_id", "text", F.to_json("entities").alias("entities"), F.to_json("context").alias("context"))


def p5_loaded_spans(spark, folder):
    return rejects.loaded_spans(rejects.decode(_read(spark, folder, "raw_rows")))


def line_split(spark, folder):
    return _longs(lines.split_lines(_docs(spark, folder)).drop("content"))


def line_stats_by_lang(spark, folder):
    docs = _read(spark, folder, "documents").select("doc_id", "text", F.lower(F.substring("lang", 1, 2)).alias("lang"))
    parts = docs.select("lang", F.explode(lines.line_array(F.col("text"))).alias("line"))
    return parts.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length("line")).cast("long").alias("longest"))


def normal_forms(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(tx.normal_form("text")).alias("normal_md5"))


def line_shapes(spark, folder):
    made = lines.split_lines(_docs(spark, folder))
    return _longs(made.select("doc_id", "line_no", F.md5(tx.shape(F.col("content"))).alias("shape_md5")))


def _worded(spark, folder):
    return lines.split_lines(_documents(spark, folder).select("doc_id", "text")).withColumn("normal", tx.normal_form("content")).withColumn("words", tx.words(F.col("normal")))


def line_words(spark, folder):
    w = _worded(spark, folder).withColumn("pairs", tx.bigrams(F.col("words")))
    return _longs(w.select("doc_id", "line_no", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"), F.md5(F.array_join("pairs", " ")).alias("bigrams_md5")))


def neighbour_words(spark, folder):
    w = Window.partitionBy("doc_id").orderBy("line_no")
    joined = _worded(spark, folder).select("doc_id", "line_no", F.array_join("words", " ").alias("words"))
    return _longs(joined.select("doc_id", "line_no", F.md5(F.coalesce(F.lag("words").over(w), F.lit(""))).alias("previous_md5"), F.md5(F.coalesce(F.lead("words").over(w), F.lit(""))).alias("next_md5")))


def char_ngrams(spark, folder):
    n = _worded(spark, folder).select("doc_id", "line_no", F.concat(F.lit("^"), "normal", F.lit("$")).alias("x"))
    sized = n.select("doc_id", "line_no", F.explode(F.array(*(F.struct(F.lit(k).alias("size"), F.size(F.array_distinct(tx.ngrams(F.col("x"), k))).alias("n")) for k in (3, 4, 5)))).alias("g"))
    return _longs(sized.select("doc_id", "line_no", "g.size", F.col("g.n").alias("n_distinct")))


def feature_buckets(spark, folder):
    words = _worded(spark, folder).select(F.explode("words").alias("word")).distinct()
    return _longs(words.select("word", tx.bucket(F.concat(F.lit("current:word:"), "word"), DIMENSION).alias("bucket")))


def position_length_buckets(spark, folder):
    arrays = _docs(spark, folder).select("doc_id", lines.line_array(F.col("text")).alias("parts"))
    rows = arrays.select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("line_no", "content")).withColumn("normal", tx.normal_form("content"))
    return _longs(rows.select("doc_id", "line_no", F.least(F.lit(19), F.expr("20 * line_no DIV greatest(1, n)")).alias("position_bucket"), F.least(F.lit(20), F.expr("length(normal) DIV 5")).alias("length_bucket")))


def label_inventory(spark, folder):
    return metrics.label_inventory(_gold(spark, folder))


def overlapping_annotations(spark, folder):
    return _longs(metrics.overlapping_annotations(_gold(spark, folder)))


def refined_token_bounds(spark, folder):
    return _longs(refined_tokens(_read(spark, folder, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum((F.col("token_start") * (F.col("token_no") + 1)).cast("long")).alias("checksum")))


def trimmed_spans(spark, folder):
    return _longs(spans.trim_spans(_spans(spark, folder), _docs(spark, folder)))


def merged_spans(spark, folder):
    return _longs(spans.merge_spans(_spans(spark, folder)))


def expanded_spans(spark, folder):
    return _longs(spans.align_spans(_spans(spark, folder), _docs(spark, folder), "expand"))


def strict_spans(spark, folder):
    return _longs(spans.align_spans(_spans(spark, folder), _docs(spark, folder), "strict"))


def aligned_gold(spark, folder):
    docs = _annotated(spark, folder)
    return _longs(alignment.aligned_gold(docs, spans.gold_spans(docs)))


def line_rule_overlaps(spark, folder):
    return _longs(spans.line_span_overlaps(lines.split_lines(_docs(spark, folder)), _spans(spark, folder, 1)))


def _annotated(spark, folder):
    return _read(spark, folder, "documents").where("entities IS NOT NULL").select("doc_id", "text", "entities")


def rule_coverage(spark, folder):
    return _longs(spans.rule_coverage(lines.split_lines(_annotated(spark, folder)), _spans(spark, folder, 1)))


def residual_lines(spark, folder):
    docs = _annotated(spark, folder)
    return _longs(metrics.residual_lines(docs, spans.gold_spans(docs), _spans(spark, folder, 1)))


def class_balance(spark, folder):
    from noteforge.operators.router import class_balance as balance

    return balance(residual_lines(spark, folder))


def latest_scores(spark, folder):
    return _longs(_scores(spark, folder))


def selected_by_profile(spark, folder):
    chosen = _scores(spark, folder).join(F.broadcast(_read(spark, folder, "profiles")), F.col("score") >= F.col("threshold"))
    return chosen.groupBy("profile").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_documents"))


def _selected(spark, folder, threshold, annotated=True):
    """Selected lines, of annotated documents or of all."""
    docs = _annotated(spark, folder) if annotated else _docs(spark, folder)
    return lines.select_lines(lines.split_lines(docs), _scores(spark, folder), threshold)


def packed_texts(spark, folder):
    return _longs(lines.pack_lines(_selected(spark, folder, BALANCED, False)).select("doc_id", F.md5("packed_text").alias("packed_md5"), "n_segments", "selected_characters", "model_characters"))


def packed_segments(spark, folder):
    return _longs(lines.segments(_selected(spark, folder, BALANCED, False)))


def projected_spans(spark, folder):
    segs = lines.segments(_selected(spark, folder, BALANCED))
    return _longs(lines.project_spans(lines.spans_in_segments(_spans(spark, folder, 0), segs), segs).drop("source"))


def _routed(spark, folder, threshold):
    segs = lines.segments(_selected(spark, folder, threshold))
    model = lines.project_spans(lines.spans_in_segments(_spans(spark, folder, 0), segs), segs)
    return spans.merge_spans(model.unionByName(_spans(spark, folder, 1)))


def routed_all_lines(spark, folder):
    return _longs(_routed(spark, folder, None))


def routed_balanced(spark, folder):
    return _longs(_routed(spark, folder, BALANCED))


def routed_rules_only(spark, folder):
    return _longs(_routed(spark, folder, 1.0))


def exact_metrics(spark, folder):
    return metrics.with_rates(metrics.exact_counts(_gold(spark, folder), _spans(spark, folder)))


def exact_metrics_by_label(spark, folder):
    return metrics.with_rates(metrics.exact_counts(_gold(spark, folder), _spans(spark, folder), ["label"]))


def character_recall(spark, folder):
    return metrics.character_recall(_annotated(spark, folder), _gold(spark, folder), _spans(spark, folder))


def group_recall(spark, folder):
    groups = spark.createDataFrame([(g, x) for g, labels in GROUPS.items() for x in labels], "grp string, label string")
    return metrics.character_recall(_annotated(spark, folder), _gold(spark, folder), _spans(spark, folder), groups)


def calibration_points(spark, folder):
    scored = lines.split_lines(_docs(spark, folder)).join(_scores(spark, folder), ["doc_id", "line_no"]).groupBy("doc_id", "score").agg(F.sum(F.col("line_end") - F.col("line_start")).alias("c"), F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    states = scored.select("doc_id", "score", F.sum("c").over(w).alias("selected_chars"), F.sum("n").over(w).alias("selected_lines"))
    none = scored.select("doc_id").distinct().select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("selected_chars"), F.lit(0).cast("long").alias("selected_lines"))
    return calibration.calibration_points(states.unionByName(none), ["selected_chars", "selected_lines"])


def calibrated_profiles(spark, folder):
    points = _read(spark, folder, "points")
    budgets = spark.createDataFrame(list(calibration.BUDGETS.items()), "profile string, loss double")
    return calibration.choose_thresholds(points, points.where("threshold = 0"), budgets)


def rule_span_counts(spark, folder):
    docs = rules.with_rule_spans(_documents(spark, folder).select("doc_id", "text", "context"))
    return rules.exploded(docs).groupBy("label").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_documents"))


def rule_spans(spark, folder):
    return _longs(rules.exploded(rules.with_rule_spans(_documents(spark, folder).select("doc_id", "text", "context"))))


def mail_values(spark, folder):
    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(lambda t: rules.mail_values(rules.same_length_fold(t)), na_action="ignore")

    return _docs(spark, folder).select("doc_id", F.explode(found("text")).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def training_chunks(spark, folder):
    return _longs(chunks.training_chunks(_annotated(spark, folder)).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"), F.size("entities").alias("n_entities")))


def _train(spark, folder):
    """Annotated documents of train and of validation, labels in one spelling."""
    named = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), spans.plain_label(e["label"]).alias("label")))
    docs = _documents(spark, folder).where("entities IS NOT NULL").select("doc_id", "text", named.alias("entities"), "context", "split")
    return tuple(docs.where(F.col("split") == x).drop("split") for x in ("train", "validation"))


def _fitted(spark, folder):
    return Deidentifier.from_preset("token").fit(*_train(spark, folder))


def router_scores(spark, folder):
    router = LineRouter(RouterConfig()).fit(rules.with_rule_spans(_train(spark, folder)[0]), spans.IDENTIFIERS)
    return _longs(router.score_lines(rules.with_rule_spans(_documents(spark, folder).select("doc_id", "text", "context"))))


def predict_end_to_end(spark, folder):
    found = _fitted(spark, folder).predict(_documents(spark, folder).select("doc_id", "text", "context"), "balanced")
    return _longs(found.select("doc_id", F.explode("entities").alias("e"), "selected_characters", "model_characters").select("doc_id", F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"), "e.label", "selected_characters", "model_characters"))


def fitted_profiles(spark, folder):
    return spark.createDataFrame(sorted(_fitted(spark, folder).thresholds.items()), "profile string, threshold double")


_NAMES = """p5_found p5_loaded_notes p5_loaded_spans line_split line_stats_by_lang normal_forms line_shapes line_words neighbour_words char_ngrams feature_buckets position_length_buckets
label_inventory overlapping_annotations refined_token_bounds trimmed_spans merged_spans expanded_spans strict_spans aligned_gold line_rule_overlaps rule_coverage residual_lines class_balance latest_scores
selected_by_profile packed_texts packed_segments projected_spans routed_all_lines routed_balanced routed_rules_only exact_metrics exact_metrics_by_label character_recall group_recall
calibration_points calibrated_profiles rule_span_counts rule_spans mail_values training_chunks router_scores predict_end_to_end fitted_profiles"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

# SQL. Pieces that several queries share come first.

_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_PLAIN = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
_BLANKS = r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+"


def _normal(x: str) -> str:
    compatible = f"translate(replace(replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), chr(8209), chr(8208)), '{_WIDE}µ', '{_PLAIN}μ')"
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower({compatible})), '\p{{Nd}}', '0', 'g'), '{_BLANKS}', ' ', 'g'))"


_LINES = r"""line_parts AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS parts FROM documents),
line_rows AS (SELECT doc_id, len(parts) AS n, unnest(range(len(parts))) AS line_no, unnest(parts) AS content FROM line_parts),
lines AS (SELECT doc_id, n, line_no, content, (sum(length(content)) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS line_end, (sum(length(content)) OVER (PARTITION BY doc_id ORDER BY line_no) - length(content))::BIGINT AS line_start FROM line_rows)"""


def _label(x: str) -> str:
    return f"CASE upper(trim({x})) WHEN 'EMAIL' THEN 'MAIL' WHEN 'TELEPHONE' THEN 'TEL' ELSE upper(trim({x})) END"


_SPANS = f"""valid AS (SELECT doc_id, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end, {_label("label")} AS label, source::BIGINT AS source
  FROM (SELECT DISTINCT ON (span_id) * FROM spans) WHERE span_start >= 0 AND span_end > span_start AND length(label) > 0)"""
_GOLD = f"""gold AS (SELECT doc_id, e.start::BIGINT AS span_start, e."end"::BIGINT AS span_end, {_label("e.label")} AS label FROM (SELECT doc_id, unnest(entities) AS e FROM documents))"""
_SCORES = """latest AS (SELECT doc_id, line_no::BIGINT AS line_no, arg_max(score, (loaded_at, scored_at, score)) AS score FROM scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"""


def _merged(name: str, source: str) -> str:
    """Overlapping spans of a table united, as `name`."""
    return f"""{name}_1 AS (SELECT *, CASE WHEN span_start < max(span_end) OVER (PARTITION BY doc_id ORDER BY span_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN NULL ELSE span_start END AS fresh FROM {source}),
{name}_2 AS (SELECT *, max(fresh) OVER (PARTITION BY doc_id ORDER BY span_start RANGE UNBOUNDED PRECEDING) AS island FROM {name}_1),
{name} AS (SELECT doc_id, min(span_start) AS span_start, max(span_end) AS span_end, arg_min(label, (span_start - span_end, span_start, source, label)) AS label FROM {name}_2 GROUP BY doc_id, island)"""


_ANNOTATED = "annotated AS (SELECT doc_id FROM documents WHERE entities IS NOT NULL)"
_CHARS = r"""chars AS (SELECT DISTINCT doc_id, span_start + k AS pos, label FROM (SELECT g.doc_id, span_start, label, substr(text, span_start + 1, span_end - span_start) AS piece, unnest(range(span_end - span_start)) AS k FROM gold g JOIN documents USING (doc_id))
  WHERE regexp_full_match(substr(piece, k + 1, 1), '[\p{L}\p{N}]'))"""


def _segments(threshold: float | None, annotated: bool = True) -> str:
    joined = " JOIN annotated USING (doc_id)" if annotated else ""
    chosen = "" if threshold is None else f" JOIN latest USING (doc_id, line_no) WHERE score >= {threshold}"
    return f"""{_LINES}, {_ANNOTATED}, {_SCORES}, chosen AS (SELECT doc_id, line_no, line_start, line_end, content FROM lines{joined}{chosen}),
runs_1 AS (SELECT *, CASE WHEN line_start = lag(line_end) OVER (PARTITION BY doc_id ORDER BY line_start) THEN 0 ELSE 1 END AS fresh FROM chosen),
runs_2 AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_start) AS run FROM runs_1),
runs AS (SELECT doc_id, run, min(line_start) AS run_start, max(line_end) AS run_end, string_agg(content, '' ORDER BY line_start) AS chunk FROM runs_2 GROUP BY doc_id, run),
segments AS (SELECT doc_id, row_number() OVER w - 1 AS seg_no, coalesce(sum(run_end - run_start + 1) OVER (PARTITION BY doc_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS packed_start, run_start AS document_start, run_end - run_start AS size FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run))"""


def _route(threshold: float | None) -> str:
    return f"""WITH {_segments(threshold)}, {_SPANS}, kept AS (SELECT v.* FROM valid v JOIN segments s ON v.doc_id = s.doc_id AND s.document_start <= v.span_start AND v.span_end <= s.document_start + s.size WHERE v.source = 0),
both_sides AS (SELECT * FROM kept UNION ALL SELECT * FROM valid WHERE source = 1), {_merged("united", "both_sides")} SELECT * FROM united"""


_RATES = """CASE WHEN n_predicted <> 0 THEN tp::DOUBLE / n_predicted ELSE 0 END AS precision, CASE WHEN n_gold <> 0 THEN tp::DOUBLE / n_gold ELSE 0 END AS recall,
CASE WHEN n_gold + n_predicted <> 0 THEN (2 * tp)::DOUBLE / (n_gold + n_predicted) ELSE 0 END AS f1, CASE WHEN 4 * n_gold + n_predicted <> 0 THEN (5 * tp)::DOUBLE / (4 * n_gold + n_predicted) ELSE 0 END AS f2"""


def _exact(by: str) -> str:
    return f"""WITH {_GOLD}, {_SPANS}, g AS (SELECT DISTINCT * FROM gold), p AS (SELECT DISTINCT doc_id, span_start, span_end, label FROM valid),
each_one AS (SELECT doc_id, span_start, span_end, label, g.doc_id IS NOT NULL AS in_gold, p.doc_id IS NOT NULL AS found FROM g FULL JOIN p USING (doc_id, span_start, span_end, label)),
counts AS (SELECT {by + "," if by else ""} count(*) FILTER (WHERE in_gold AND found) AS tp, count(*) FILTER (WHERE found) AS n_predicted, count(*) FILTER (WHERE in_gold) AS n_gold FROM each_one {"GROUP BY " + by if by else ""})
SELECT *, {_RATES} FROM counts"""


def _recall(groups: str) -> str:
    return f"""WITH {_GOLD}, {_SPANS}, {_CHARS}, {_merged("ranges", "valid")}, groups(grp, label) AS ({groups}),
marked AS (SELECT DISTINCT grp, c.doc_id, pos, EXISTS (SELECT 1 FROM ranges r WHERE r.doc_id = c.doc_id AND r.span_start <= pos AND pos < r.span_end) AS hit FROM chars c JOIN groups USING (label))
SELECT grp, count(*) FILTER (WHERE hit) AS covered, count(*) AS support, (count(*) FILTER (WHERE hit))::DOUBLE / count(*) AS recall FROM marked GROUP BY grp"""


_SIGNS = "".join("\\" + c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_cut = lambda s, keep: "".join("\\" + c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" if c not in keep)


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _trim(group: int) -> str:
    pattern = lambda lead, tail: _quoted(rf"(?s)^([\s{lead}]*)(.*?)[\s{tail}]*$")
    return f"""CASE label WHEN 'TEL' THEN regexp_extract(piece, '{pattern(_cut(_SIGNS, "+("), _SIGNS)}', {group}) WHEN 'PRENOM' THEN regexp_extract(piece, '{pattern(_SIGNS, _cut(_SIGNS, "."))}', {group}) ELSE regexp_extract(piece, '{pattern(_SIGNS, _SIGNS)}', {group}) END"""


_TOKENS = r"""token_parts AS (SELECT doc_id, regexp_extract_all(text, '(?s)\p{Nd}+|\p{L}[\p{L}\p{M}]*|\n|[\t\x0b\f\r ]+|.') AS parts FROM documents),
token_rows AS (SELECT doc_id, unnest(range(len(parts))) AS token_no, unnest(parts) AS token FROM token_parts),
tokens AS (SELECT doc_id, token_no, (sum(length(token)) OVER w - length(token))::BIGINT AS token_start, (sum(length(token)) OVER w)::BIGINT AS token_end FROM token_rows WINDOW w AS (PARTITION BY doc_id ORDER BY token_no))"""
_TOUCHED = f"""{_SPANS}, {_TOKENS}, touched AS (SELECT v.doc_id, span_start, span_end, label, source, min(token_start) AS first_start, max(token_end) AS last_end FROM valid v JOIN tokens t ON v.doc_id = t.doc_id AND token_start < span_end AND span_start < token_end GROUP BY ALL)"""
_NORMAL_LINES = f"""{_LINES}, normal_lines AS (SELECT doc_id, n, line_no, {_normal("content")} AS normal FROM lines)"""
_WORDS = r"regexp_extract_all(normal, '[a-z0-9]+|[^\p{L}\p{N}_\s]')"
_RESIDUAL = f"""{_GOLD}, {_SPANS}, {_CHARS}, {_LINES}, {_ANNOTATED},
missed AS (SELECT DISTINCT doc_id, pos FROM chars c WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.source = 1 AND v.doc_id = c.doc_id AND v.span_start <= pos AND pos < v.span_end)),
residual AS (SELECT doc_id, line_no::BIGINT AS line_no, EXISTS (SELECT 1 FROM missed m WHERE m.doc_id = l.doc_id AND l.line_start <= m.pos AND m.pos < l.line_end) AS is_residual FROM lines l JOIN annotated USING (doc_id))"""
_ALNUM = r"length(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"

_FIELD = r'"(?:[^"]|"")*"|[^";]*'
_DECODED = rf"""notes_1 AS (SELECT row_id, raw, coalesce(json_valid(raw) AND NOT regexp_matches(regexp_replace(raw, '"(?:[^"\\]|\\.)*"', '""', 'g'), '(?i)nan|inf|,\s*[\]}}]'), false) AS good FROM raw_rows WHERE feed = 'notes_jsonl'),
notes_2 AS (SELECT row_id, CASE WHEN good THEN TRY_CAST(raw AS JSON) END AS j FROM notes_1),
notes_3 AS (SELECT row_id, j, j ->> '$.text' AS txt, CASE WHEN json_type(j, '$.entities') = 'ARRAY' THEN json_extract(j, '$.entities[*]') END AS es FROM notes_2),
notes AS (SELECT row_id, CASE WHEN j IS NULL THEN 'syntax' WHEN json_type(j) <> 'OBJECT' THEN 'object' WHEN coalesce(json_type(j, '$.text'), '') <> 'VARCHAR' OR txt = '' THEN 'text'
  WHEN es IS NULL OR list_bool_or(list_transform(es, lambda e: json_type(e) <> 'OBJECT')) THEN 'entity'
  WHEN list_bool_or(list_transform(es, lambda e: NOT coalesce(json_type(e, '$.start') IN ('UBIGINT', 'BIGINT') AND json_type(e, '$.end') IN ('UBIGINT', 'BIGINT') AND TRY_CAST(e ->> '$.start' AS BIGINT) >= 0
    AND TRY_CAST(e ->> '$.start' AS BIGINT) < TRY_CAST(e ->> '$.end' AS BIGINT) AND TRY_CAST(e ->> '$.end' AS BIGINT) <= length(txt), false))) THEN 'offsets'
  WHEN list_bool_or(list_transform(es, lambda e: coalesce(json_type(e, '$.label'), '') <> 'VARCHAR' OR e ->> '$.label' = '')) THEN 'label'
  WHEN list_bool_or(list_transform(es, lambda e, i: list_bool_or(list_transform(es, lambda f, k: k > i AND TRY_CAST(e ->> '$.start' AS BIGINT) < TRY_CAST(f ->> '$.end' AS BIGINT) AND TRY_CAST(f ->> '$.start' AS BIGINT) < TRY_CAST(e ->> '$.end' AS BIGINT))))) THEN 'overlap'
  WHEN coalesce(json_type(j, '$.context'), 'NULL') NOT IN ('NULL', 'OBJECT') OR list_bool_or(list_transform(json_extract(j, '$.context.*'), lambda v: json_type(v) <> 'ARRAY'))
    OR list_bool_or(list_transform(flatten(list_transform(json_extract(j, '$.context.*'), lambda v: json_extract(v, '$[*]'))), lambda x: json_type(x) <> 'VARCHAR')) THEN 'context' END AS reason FROM notes_3),
spans_1 AS (SELECT row_id, coalesce(raw, '') AS raw FROM raw_rows WHERE feed = 'spans_csv'),
spans_2 AS (SELECT row_id, regexp_full_match(raw, '(?:{_FIELD})(?:;(?:{_FIELD}))*') AS good, list_transform(regexp_extract_all(';' || raw, ';({_FIELD})', 1), lambda f: CASE WHEN f[1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END) AS f FROM spans_1),
csv_spans AS (SELECT row_id, CASE WHEN NOT good THEN 'quoting' WHEN len(f) <> 5 THEN 'columns' WHEN f[2] = '' THEN 'text'
  WHEN NOT coalesce(regexp_full_match(f[3], '[0-9]+') AND regexp_full_match(f[4], '[0-9]+') AND TRY_CAST(f[3] AS HUGEINT) < TRY_CAST(f[4] AS HUGEINT) AND TRY_CAST(f[4] AS HUGEINT) <= length(f[2]), false) THEN 'offsets' WHEN f[5] = '' THEN 'label' END AS reason, f FROM spans_2)"""

_FOLDED = """folded AS (SELECT doc_id, text, strip_accents(lower(translate(text, 'FW' || chr(160) || chr(8199) || chr(8201) || chr(8239) || chr(12288), 'AS' || '     '))) AS t FROM documents)""".replace("FW", "".join(chr(0xFF01 + k) for k in range(94))).replace("'AS'", "'" + _PLAIN + "'")
_ATOMS = r"[a-z0-9!#$%&''*+/=?^_`{|}~-]+"
#: A mail address as RFC 5321 has it: a dot-string or a quoted string, then a domain or an address literal.
_ADDRESS_SPEC = rf"""({_ATOMS}( ?\. ?{_ATOMS})*|"[^"\n]*") ?@ ?([a-z0-9]([a-z0-9-]*[a-z0-9])?( ?\. ?[a-z0-9]([a-z0-9-]*[a-z0-9])?)+|\[[0-9. ]+\])"""

ORACLE: dict[str, str] = {
    "p5_found": f"WITH {_DECODED} SELECT row_id, reason FROM notes WHERE reason IS NOT NULL UNION ALL SELECT row_id, reason FROM csv_spans WHERE reason IS NOT NULL UNION ALL SELECT row_id, 'feed' FROM raw_rows WHERE feed IS NULL OR feed NOT IN ('notes_jsonl', 'spans_csv')",
    "p5_loaded_notes": rf"""WITH {_DECODED}, good_notes AS (SELECT row_id, j FROM notes JOIN notes_3 USING (row_id) WHERE reason IS NULL), es AS (SELECT row_id, unnest(json_extract(j, '$.entities[*]')) AS e FROM good_notes),
typed AS (SELECT row_id, list({{'start': (e ->> '$.start')::INT, 'end': (e ->> '$.end')::INT, 'label': e ->> '$.label'}} ORDER BY (e ->> '$.start')::INT) AS entities FROM es GROUP BY row_id)
SELECT row_id, j ->> '$.text' AS text, coalesce(to_json(entities)::VARCHAR, '[]') AS entities, CASE WHEN json_type(j, '$.context') = 'OBJECT' THEN json_extract(j, '$.context')::VARCHAR END AS context FROM good_notes LEFT JOIN typed USING (row_id)""",
    "p5_loaded_spans": f"WITH {_DECODED} SELECT row_id, f[1] AS note, f[2] AS text, f[3]::BIGINT AS span_start, f[4]::BIGINT AS span_end, f[5] AS label FROM csv_spans WHERE reason IS NULL",
    "line_split": f"WITH {_LINES} SELECT doc_id, line_no::BIGINT AS line_no, line_start, line_end FROM lines",
    "line_stats_by_lang": f"WITH {_LINES} SELECT lower(substr(lang, 1, 2)) AS lang, count(*) AS n_lines, sum(length(content))::BIGINT AS n_chars, max(length(content))::BIGINT AS longest FROM lines JOIN documents USING (doc_id) GROUP BY 1",
    "normal_forms": f"SELECT doc_id, md5({_normal('text')}) AS normal_md5 FROM documents",
    "line_shapes": rf"WITH {_LINES} SELECT doc_id, line_no::BIGINT AS line_no, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\p{{Lu}}+', 'A', 'g'), '\p{{Ll}}+', 'a', 'g'), '\p{{Nd}}+', '0', 'g'), '{_BLANKS}', ' ', 'g'))) AS shape_md5 FROM lines",
    "line_words": f"WITH {_NORMAL_LINES} SELECT doc_id, line_no::BIGINT AS line_no, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS words_md5, md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]), ' ')) AS bigrams_md5 FROM (SELECT doc_id, line_no, {_WORDS} AS w FROM normal_lines)",
    "neighbour_words": f"WITH {_NORMAL_LINES}, joined AS (SELECT doc_id, line_no, array_to_string({_WORDS}, ' ') AS w FROM normal_lines) SELECT doc_id, line_no::BIGINT AS line_no, md5(coalesce(lag(w) OVER o, '')) AS previous_md5, md5(coalesce(lead(w) OVER o, '')) AS next_md5 FROM joined WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)",
    "char_ngrams": f"WITH {_NORMAL_LINES}, x AS (SELECT doc_id, line_no, '^' || normal || '$' AS x FROM normal_lines) SELECT doc_id, line_no::BIGINT AS line_no, size::BIGINT AS size, len(list_distinct(list_transform(range(1, greatest(1, length(x) - size + 2)), lambda i: substr(x, i, size))))::BIGINT AS n_distinct FROM x, (SELECT unnest([3, 4, 5]) AS size)",
    "feature_buckets": f"""WITH {_NORMAL_LINES}, w AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM normal_lines), b AS (SELECT word, hex(encode('current:word:' || word)) AS h FROM w),
y AS (SELECT word, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM b)
SELECT word, 1 + xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END)), 4294967295::BIGINT) % {DIMENSION - 1} AS bucket FROM y""",
    "position_length_buckets": f"WITH {_NORMAL_LINES} SELECT doc_id, line_no::BIGINT AS line_no, least(19, 20 * line_no // greatest(1, n))::BIGINT AS position_bucket, least(20, length(normal) // 5)::BIGINT AS length_bucket FROM normal_lines",
    "label_inventory": f"WITH {_GOLD} SELECT label, count(*) AS n_spans, count(DISTINCT doc_id) AS n_documents FROM gold GROUP BY label",
    "overlapping_annotations": f"WITH {_GOLD} SELECT * FROM (SELECT doc_id, span_start, span_end, lead(span_start) OVER (PARTITION BY doc_id ORDER BY span_start, span_end, label) AS next_start FROM gold) WHERE span_end > next_start",
    "refined_token_bounds": f"""WITH {_TOKENS}, {_GOLD}, places AS (SELECT doc_id, 0 AS p FROM documents UNION SELECT doc_id, token_end FROM tokens UNION SELECT doc_id, span_start FROM gold UNION SELECT doc_id, span_end FROM gold),
pairs AS (SELECT doc_id, p, row_number() OVER w - 1 AS token_no, lead(p) OVER w AS e FROM places WINDOW w AS (PARTITION BY doc_id ORDER BY p)) SELECT doc_id, count(*) AS n_tokens, sum(p * (token_no + 1))::BIGINT AS checksum FROM pairs WHERE e IS NOT NULL GROUP BY doc_id""",
    "trimmed_spans": f"""WITH {_SPANS}, pieces AS (SELECT v.*, substr(text, span_start + 1, span_end - span_start) AS piece FROM valid v JOIN documents USING (doc_id)),
cut AS (SELECT *, length({_trim(1)}) AS lead_length, length({_trim(2)}) AS kept FROM pieces WHERE regexp_replace(piece, '[ \\n{_quoted(_SIGNS)}]+', '', 'g') <> '')
SELECT doc_id, span_start + lead_length AS span_start, span_start + lead_length + kept AS span_end, label, source FROM cut WHERE kept > 0""",
    "merged_spans": f"WITH {_SPANS}, {_merged('united', 'valid')} SELECT * FROM united",
    "expanded_spans": f"WITH {_TOUCHED} SELECT doc_id, first_start AS span_start, last_end AS span_end, label, source FROM touched",
    "strict_spans": f"WITH {_TOUCHED} SELECT doc_id, span_start, span_end, label, source FROM touched WHERE first_start = span_start AND last_end = span_end",
    "aligned_gold": f"""WITH {_GOLD}, {_TOKENS}, wide AS (SELECT g.doc_id, span_start, span_end, label, min(token_start) AS s, max(token_end) AS e, count(*) AS n FROM (SELECT DISTINCT * FROM gold) g JOIN tokens t ON g.doc_id = t.doc_id AND token_start < span_end AND span_start < token_end GROUP BY ALL),
marked AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, span_start, span_end, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM wide),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e, span_start, span_end, label ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT doc_id, min(s) AS span_start, max(e) AS span_end, arg_min(label, (-n, s, span_start, span_end, label)) AS label FROM islands GROUP BY doc_id, island""",
    "line_rule_overlaps": f"WITH {_SPANS}, {_LINES} SELECT l.doc_id, line_no::BIGINT AS line_no, span_start, span_end, label FROM lines l JOIN valid v ON v.source = 1 AND v.doc_id = l.doc_id AND span_start < line_end AND line_start < span_end",
    "rule_coverage": f"""WITH {_SPANS}, {_LINES}, {_ANNOTATED}, rule_spans AS (SELECT * FROM valid WHERE source = 1), {_merged("ranges", "rule_spans")},
hits AS (SELECT l.doc_id, line_no, least(8, count(*)) AS n_rules, array_to_string(list_sort(list_distinct(list(label))), ',') AS rules FROM lines l JOIN rule_spans v ON v.doc_id = l.doc_id AND span_start < line_end AND line_start < span_end GROUP BY ALL),
covered AS (SELECT l.doc_id, line_no, sum({_ALNUM.format("substr(content, greatest(line_start, span_start) - line_start + 1, least(line_end, span_end) - greatest(line_start, span_start))")})::BIGINT AS covered FROM lines l JOIN ranges r ON r.doc_id = l.doc_id AND span_start < line_end AND line_start < span_end GROUP BY ALL),
base AS (SELECT l.doc_id, l.line_no, coalesce(n_rules, 0) AS n_rules, coalesce(rules, '') AS rules, coalesce(covered, 0) AS covered, {_ALNUM.format("content")}::BIGINT AS alnum FROM lines l JOIN annotated USING (doc_id) LEFT JOIN hits USING (doc_id, line_no) LEFT JOIN covered USING (doc_id, line_no))
SELECT doc_id, line_no::BIGINT AS line_no, n_rules::BIGINT AS n_rules, rules, covered, alnum, least(10, round_even(10.0::DOUBLE * covered / greatest(1, alnum), 0))::BIGINT AS coverage_bucket FROM base""",
    "residual_lines": f"WITH {_RESIDUAL} SELECT * FROM residual",
    "class_balance": f"WITH {_RESIDUAL} SELECT count(*) AS n_lines, count(*) FILTER (WHERE is_residual) AS n_positive, (count(*) FILTER (WHERE NOT is_residual))::DOUBLE / nullif(count(*) FILTER (WHERE is_residual), 0) AS positive_weight FROM residual",
    "latest_scores": f"WITH {_SCORES} SELECT * FROM latest",
    "selected_by_profile": f"WITH {_SCORES} SELECT profile, count(*) AS n_lines, count(DISTINCT doc_id) AS n_documents FROM latest JOIN profiles ON score >= threshold GROUP BY profile",
    "packed_texts": f"WITH {_segments(BALANCED, False)} SELECT doc_id, md5(string_agg(chunk, chr(10) ORDER BY run)) AS packed_md5, count(*) AS n_segments, sum(run_end - run_start)::BIGINT AS selected_characters, (sum(run_end - run_start) + count(*) - 1)::BIGINT AS model_characters FROM runs GROUP BY doc_id",
    "packed_segments": f"WITH {_segments(BALANCED, False)} SELECT doc_id, seg_no, packed_start, packed_start + size AS packed_end, document_start FROM segments",
    "projected_spans": f"WITH {_segments(BALANCED)}, {_SPANS} SELECT v.doc_id, span_start, span_end, label FROM valid v JOIN segments s ON v.doc_id = s.doc_id AND s.document_start <= v.span_start AND v.span_end <= s.document_start + s.size WHERE source = 0",
    "routed_all_lines": _route(None),
    "routed_balanced": _route(BALANCED),
    "routed_rules_only": _route(1.0),
    "exact_metrics": _exact(""),
    "exact_metrics_by_label": _exact("label"),
    "character_recall": _recall("SELECT DISTINCT 'all', label FROM gold"),
    "group_recall": _recall(" UNION ALL ".join(f"SELECT '{g}', '{x}'" for g, labels in GROUPS.items() for x in labels)),
    "calibration_points": f"""WITH {_LINES}, {_SCORES}, scored AS (SELECT score, line_end - line_start AS c FROM lines JOIN latest USING (doc_id, line_no)), by_score AS (SELECT score AS threshold, sum(c) AS c, count(*) AS n FROM (SELECT * FROM scored UNION ALL SELECT unnest([0.0, 1.0]), NULL) GROUP BY score),
counted AS (SELECT threshold, coalesce(c, 0) AS c, (SELECT count(*) FROM scored s WHERE s.score = b.threshold) AS n FROM by_score b)
SELECT threshold, (sum(c) OVER (ORDER BY threshold DESC))::BIGINT AS selected_chars, (sum(n) OVER (ORDER BY threshold DESC))::BIGINT AS selected_lines FROM counted""",
    "calibrated_profiles": """WITH budgets(profile, loss) AS (VALUES ('prudent', 0.001::DOUBLE), ('balanced', 0.005::DOUBLE), ('fast', 0.01::DOUBLE)), base AS (SELECT recall AS r, group_recall AS g FROM points WHERE threshold = 0),
fits AS (SELECT profile, p.* FROM points p, base b, budgets WHERE b.r - p.recall <= loss + 1e-12 AND coalesce(list_bool_and(list_transform(map_keys(b.g), lambda k: coalesce(b.g[k] - p.group_recall[k] <= loss + 1e-12, true))), true))
SELECT profile, arg_min(threshold, (model_chars, selected_chars, -threshold)) AS threshold, arg_min(model_chars, (model_chars, selected_chars, -threshold)) AS model_chars, arg_min(selected_chars, (model_chars, selected_chars, -threshold)) AS selected_chars FROM fits GROUP BY profile""",
    "mail_values": f"WITH {_FOLDED} SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{_ADDRESS_SPEC}')) AS value FROM folded) GROUP BY ALL",
}
