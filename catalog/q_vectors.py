"""Note, vector and modality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.functions import text as T
from modalframe.functions import vectors as V
from modalframe.functions.numeric import round_to
from modalframe.functions.patterns import FLAGS, code_of_pattern, decode_pattern, pattern_code, pattern_complexity, pattern_string
from modalframe.operators import modality, pooling
from modalframe.operators.embedding import NOTE_TYPES, embed_notes, text_embedding_table
from modalframe.sources.wide import from_wide, to_wide

from .registry import query, r6, sql
from .views import view

E = ("v_image_embeddings",)
EXPLODED = """ex AS (SELECT vec_id, subject_id, study_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM v_image_embeddings)"""


def r5(expr):
    return r6(expr, 5)


def images(spark, sf_dir):
    return view(spark, sf_dir, "v_image_embeddings")


def notes(spark, sf_dir):
    return view(spark, sf_dir, "v_notes")


def long_form(df, ids, vec, digits=5):
    """(ids, pos, value): the comparable form of a vector column."""
    return df.select(*ids, F.posexplode(V.round_vector(vec, digits)).alias("pos", "value"))


_CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')),
 '(?i)\\[Report de-identified.*?\\]', '', 'g'), '\\*\\*[^*]*\\*\\*', '', 'g'), '([a-zA-Z])\\.([a-zA-Z])', '\\1. \\2', 'g'), '[.]{3,}', '...', 'g'), '[-]{3,}', '---', 'g')"""
CLEAN_CTE = f"cl AS (SELECT note_id, subject_id, note_type, {_CLEAN} AS c FROM v_notes)"
PRE_CTES = [
    CLEAN_CTE,
    "sen AS (SELECT note_id, unnest(string_split(c, '. ')) AS s, generate_subscripts(string_split(c, '. '), 1) AS i FROM cl WHERE length(c) > 2048)",
    "cum AS (SELECT *, sum(length(s)) OVER (PARTITION BY note_id ORDER BY i) AS total FROM sen)",
    "kept AS (SELECT note_id, coalesce(string_agg(s, '. ' ORDER BY i) FILTER (WHERE total < 1536), '') AS t FROM cum GROUP BY note_id)",
    """pre AS (SELECT cl.note_id, cl.subject_id, cl.note_type, trim(CASE WHEN kept.note_id IS NULL THEN c WHEN ends_with(t, '.') THEN t ELSE t || '.' END) AS text
      FROM cl LEFT JOIN kept ON cl.note_id = kept.note_id)""",
]


@query("note_clean", sql(("v_notes",), [CLEAN_CTE], "SELECT note_id, trim(c) AS text FROM cl"))
def note_clean(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", F.trim(T.clean_note("text")).alias("text"))


@query("note_truncate", sql(("v_notes",), PRE_CTES, "SELECT note_id, text, length(text) AS n_chars FROM pre"))
def note_truncate(spark, sf_dir):
    return notes(spark, sf_dir).select("note_id", T.preprocess_note("text").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query("note_usable", sql(("v_notes",), PRE_CTES, "SELECT subject_id, note_type, count(*) AS n, count(*) FILTER (WHERE length(trim(text)) > 0) AS n_usable FROM pre GROUP BY subject_id, note_type"))
def note_usable(spark, sf_dir):
    df = notes(spark, sf_dir).select("subject_id", "note_type", T.preprocess_note("text").alias("text"))
    return df.groupBy("subject_id", "note_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~T.is_blank("text")).alias("n_usable"))


@query("vec_parse_normalise", sql(E, [EXPLODED, "nn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id)"], f"""
SELECT vec_id, CAST(ex.pos AS INT) AS pos, {r5('CASE WHEN n > 0 THEN x / n ELSE x END')} AS value FROM ex JOIN nn USING (vec_id)
UNION ALL SELECT vec_id, CAST(g.i AS INT), 0.0::DOUBLE FROM v_image_embeddings, generate_series(64, 79) g(i)"""))
def vec_parse_normalise(spark, sf_dir):
    text = images(spark, sf_dir).select("vec_id", V.vector_json("embedding").alias("t"))
    return long_form(text, ["vec_id"], V.parse_vector("t", 80))


def _pool(name, strategy, body):
    @query(name, sql(E, [EXPLODED, "wt AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS w FROM ex)"],
                     f"SELECT subject_id, CAST(pos AS INT) AS pos, {r5(body)} AS value FROM wt GROUP BY subject_id, pos"))
    def run(spark, sf_dir):
        return long_form(pooling.pool_vectors(images(spark, sf_dir), "subject_id", "embedding", strategy), ["subject_id"], "pooled")


_pool("vec_pool_mean", "mean", "avg(x)")
_pool("vec_pool_max", "max_pool", "max(x)")
_pool("vec_pool_weighted", "weighted_mean", "sum(w * x) / sum(w)")

FLAGGED = f"fl AS (SELECT ex.*, 64 - 1 - pos AS rpos, {', '.join(FLAGS)} FROM ex JOIN v_predictions p ON ex.vec_id = p.subject_id)"
EP = ("v_image_embeddings", "v_predictions")


def four_modalities(spark, sf_dir):
    """Four same-length vectors per id, derived from the image vectors, with the availability flags of that id."""
    flags = view(spark, sf_dir, "v_predictions").select(F.col("subject_id").alias("vec_id"), *FLAGS, pattern_string().alias("pattern"))
    df = images(spark, sf_dir).join(flags, "vec_id")
    return df.select(
        "vec_id", "subject_id", *FLAGS, "pattern", V.as_double("embedding").alias("x_struct"), F.reverse(V.as_double("embedding")).alias("x_img"),
        F.transform(V.as_double("embedding"), lambda x: x * x).alias("x_text"), F.transform(V.as_double("embedding"), lambda x: -x).alias("x_rad"),
    )


XS = ["x_struct", "x_img", "x_text", "x_rad"]


@query("vec_fuse", sql(EP, [EXPLODED, FLAGGED], f"""SELECT a.vec_id, CAST(a.pos AS INT) AS pos,
 {r5('(a.has_struct * a.x + a.has_img * b.x + a.has_text * a.x * a.x - a.has_rad * a.x) / (a.has_struct + a.has_img + a.has_text + a.has_rad + 1e-8::DOUBLE)')} AS value
 FROM fl a JOIN fl b ON a.vec_id = b.vec_id AND a.rpos = b.pos"""))
def vec_fuse(spark, sf_dir):
    return long_form(four_modalities(spark, sf_dir).withColumn("f", V.fuse(XS, FLAGS)), ["vec_id"], "f")


@query("fused_representation", sql(EP, [EXPLODED, FLAGGED], f"""
SELECT vec_id, CAST(pos AS INT) AS pos, {r5('x * has_struct')} AS value FROM fl
UNION ALL SELECT vec_id, CAST(rpos + 64 AS INT), {r5('x * has_img')} FROM fl
UNION ALL SELECT vec_id, CAST(pos + 128 AS INT), {r5('x * x * has_text')} FROM fl
UNION ALL SELECT vec_id, CAST(pos + 192 AS INT), {r5('-x * has_rad')} FROM fl
UNION ALL SELECT vec_id, CAST(256 AS INT), has_struct::DOUBLE FROM fl WHERE pos = 0 UNION ALL SELECT vec_id, CAST(257 AS INT), has_img::DOUBLE FROM fl WHERE pos = 0
UNION ALL SELECT vec_id, CAST(258 AS INT), has_text::DOUBLE FROM fl WHERE pos = 0 UNION ALL SELECT vec_id, CAST(259 AS INT), has_rad::DOUBLE FROM fl WHERE pos = 0"""))
def fused_representation(spark, sf_dir):
    return long_form(four_modalities(spark, sf_dir).withColumn("f", V.mask_and_concat(XS, FLAGS)), ["vec_id"], "f")


@query("vec_masked_mean", sql(E, [EXPLODED, "tk AS (SELECT vec_id, pos // 8 AS tok, pos % 8 AS d, x, CASE WHEN (vec_id + pos // 8) % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS m FROM ex)"],
    f"SELECT vec_id, CAST(d AS INT) AS pos, {r5('sum(x * m) / greatest(sum(m), 1e-9)')} AS value FROM tk GROUP BY vec_id, d"))
def vec_masked_mean(spark, sf_dir):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when((F.col("vec_id") + i) % 3 != 0, 1).otherwise(0))
    df = images(spark, sf_dir).withColumn("tokens", tokens).withColumn("mask", mask)
    return long_form(df.withColumn("m", V.masked_mean("tokens", "mask")), ["vec_id"], "m")


@query("vec_wide_pad", sql(E, ["""li AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY study_id, vec_id) - 1 AS pos,
 '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS cell FROM v_image_embeddings)""",
    "mx AS (SELECT max(pos) AS m FROM li)", "gr AS (SELECT DISTINCT subject_id, unnest(range(0, (SELECT m + 1 FROM mx)::BIGINT)) AS pos FROM li)"],
    "SELECT g.subject_id, CAST(g.pos AS INT) AS pos, coalesce(cell, '') AS cell FROM gr g LEFT JOIN li ON g.subject_id = li.subject_id AND g.pos = li.pos"))
def vec_wide_pad(spark, sf_dir):
    wide = to_wide(images(spark, sf_dir), "subject_id", "embedding", ["study_id", "vec_id"])
    return wide.select("subject_id", F.posexplode(F.array(*[c for c in wide.columns if c != "subject_id"])).alias("pos", "cell"))


@query("vec_wide_read", sql(E, [EXPLODED, "po AS (SELECT vec_id, row_number() OVER (PARTITION BY subject_id ORDER BY study_id, vec_id) - 1 AS file_pos FROM v_image_embeddings)"],
    f"SELECT subject_id, CAST(file_pos AS INT) AS file_pos, CAST(pos AS INT) AS pos, {r6('x')} AS value FROM ex JOIN po USING (vec_id)"))
def vec_wide_read(spark, sf_dir):
    wide = to_wide(images(spark, sf_dir), "subject_id", "embedding", ["study_id", "vec_id"])
    back = from_wide(wide, "subject_id").withColumnRenamed("pos", "file_pos")
    return long_form(back, ["subject_id", "file_pos"], "embedding", 6)


@query("vec_cosine", sql(E, [EXPLODED, "pm AS (SELECT subject_id, pos, avg(x) AS m FROM ex GROUP BY subject_id, pos)"],
    f"SELECT vec_id, {r5('sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)) / 0.1')} AS similarity FROM ex JOIN pm USING (subject_id, pos) GROUP BY vec_id"))
def vec_cosine(spark, sf_dir):
    df = images(spark, sf_dir)
    pooled = pooling.pool_vectors(df, "subject_id", "embedding", "mean")
    return df.join(pooled, "subject_id").select("vec_id", round_to(V.cosine("embedding", "pooled", 0.1), 5).alias("similarity"))


@query("vec_lookup", sql(("v_patients", "v_image_embeddings"), [EXPLODED, "pm AS (SELECT subject_id, pos, avg(x) AS m FROM ex GROUP BY subject_id, pos)"],
    f"SELECT p.subject_id, CAST(g.i AS INT) AS pos, {r5('coalesce(m, 0.0)')} AS value FROM v_patients p CROSS JOIN generate_series(0, 63) g(i) LEFT JOIN pm ON p.subject_id = pm.subject_id AND g.i = pm.pos"))
def vec_lookup(spark, sf_dir):
    pooled = pooling.pool_vectors(images(spark, sf_dir), "subject_id", "embedding", "mean")
    df = modality.attach_vector(view(spark, sf_dir, "v_patients").select("subject_id"), pooled, "pooled", 64)
    return long_form(df, ["subject_id"], "pooled")


@query("path_derivation", sql(E, [], "SELECT DISTINCT subject_id, 'p' || (subject_id // 1000000) || '/p' || subject_id AS folder FROM v_image_embeddings"))
def path_derivation(spark, sf_dir):
    from modalframe.sources.records import subject_folder

    return images(spark, sf_dir).select("subject_id").distinct().withColumn("folder", subject_folder("subject_id"))


NT = ("v_patients", "v_notes", "v_image_embeddings")
_TXT = """tx AS (SELECT subject_id, max(CASE WHEN note_type = 'discharge' AND length(trim(text)) > 0 THEN 1 ELSE 0 END) AS t,
 max(CASE WHEN note_type = 'radiology' AND length(trim(text)) > 0 THEN 1 ELSE 0 END) AS r FROM v_notes GROUP BY subject_id)"""
_FLAG_CTES = [_TXT, """mf AS (SELECT p.subject_id, CAST(1 AS INT) AS has_struct, CAST(CASE WHEN p.subject_id IN (SELECT subject_id FROM v_image_embeddings) THEN 1 ELSE 0 END AS INT) AS has_img,
 CAST(coalesce(t, 0) AS INT) AS has_text, CAST(coalesce(r, 0) AS INT) AS has_rad FROM v_patients p LEFT JOIN tx ON p.subject_id = tx.subject_id)"""]


def note_columns(spark, sf_dir):
    """Notes as (subject_id, discharge text, radiology text), one row per note."""
    return notes(spark, sf_dir).select(
        "subject_id", *[F.when(F.col("note_type") == t, F.col("text")).alias(f"{t}_embedding") for t in ("discharge", "radiology")]
    )


def flags(spark, sf_dir):
    return modality.availability_flags(view(spark, sf_dir, "v_patients").select("subject_id"), images(spark, sf_dir), note_columns(spark, sf_dir))


@query("modality_flags", sql(NT, _FLAG_CTES, """SELECT *, CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT) AS pattern_code,
 concat(has_struct, has_img, has_text, has_rad) AS missing_pattern FROM mf"""))
def modality_flags(spark, sf_dir):
    return flags(spark, sf_dir)


@query("pattern_histogram", sql(("v_predictions",), ["h AS (SELECT CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT) AS pattern_code, count(*) AS n FROM v_predictions GROUP BY 1)"],
    f"SELECT pattern_code, lpad(bin(pattern_code), 4, '0') AS pattern, n, {r6('n * 100.0::DOUBLE / (SELECT sum(n) FROM h)')} AS pct FROM h"))
def pattern_histogram(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions").withColumn("pattern_code", pattern_code())
    return modality.pattern_histogram(df).withColumn("pct", round_to("pct"))


@query("pattern_encoding", sql(("v_predictions",), [], """SELECT subject_id, concat(has_struct, has_img, has_text, has_rad) AS pattern,
 CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT) AS code, CAST(has_struct + has_img + has_text + has_rad AS INT) AS modality_count,
 concat(has_struct, has_img, has_text, has_rad) AS decoded, CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT) AS recoded FROM v_predictions"""))
def pattern_encoding(spark, sf_dir):
    from modalframe.functions.patterns import modality_count

    df = view(spark, sf_dir, "v_predictions").select("subject_id", pattern_string().alias("pattern"), pattern_code().alias("code"), modality_count().alias("modality_count"))
    return df.withColumn("decoded", decode_pattern("code")).withColumn("recoded", code_of_pattern("pattern"))


_STAT_COLS = [("modality", f) for f in FLAGS] + [("label", f"{t}_target") for t in ("readmission", "icu", "mortality")]


@query("dataset_stats", sql(("v_predictions",), [], "SELECT 'rows' AS item, 'total' AS kind, count(*) AS n, 100.0::DOUBLE AS pct FROM v_predictions UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', '{k}', CAST(sum({c}) AS BIGINT), {r6(f'avg({c}) * 100.0')} FROM v_predictions" for k, c in _STAT_COLS)))
def dataset_stats(spark, sf_dir):
    labels = [c for k, c in _STAT_COLS if k == "label"]
    return modality.dataset_statistics(view(spark, sf_dir, "v_predictions"), FLAGS, labels).withColumn("pct", round_to("pct"))


@query("embedding_coverage", sql(NT, [_TXT, "e AS (SELECT p.subject_id, coalesce(t, 0) AS t, coalesce(r, 0) AS r FROM v_patients p LEFT JOIN tx ON p.subject_id = tx.subject_id)"],
    f"""SELECT count(*) AS n, CAST(sum(t) AS BIGINT) AS n_text, CAST(sum(r) AS BIGINT) AS n_rad, CAST(sum(t * r) AS BIGINT) AS n_both,
 {r6('sum(t) * 100.0::DOUBLE / count(*)')} AS pct_text, {r6('sum(r) * 100.0::DOUBLE / count(*)')} AS pct_rad FROM e"""))
def embedding_coverage(spark, sf_dir):
    # presence is all that counts: a short marker stands for the note
    usable = [F.max(F.when(~T.is_blank(c), F.lit("x"))).alias(c) for c in ("discharge_embedding", "radiology_embedding")]
    per_subject = note_columns(spark, sf_dir).groupBy("subject_id").agg(*usable)
    df = view(spark, sf_dir, "v_patients").select("subject_id").join(per_subject, "subject_id", "left")
    cov = pooling.embedding_coverage(df)
    return cov.withColumn("pct_text", round_to("pct_text")).withColumn("pct_rad", round_to("pct_rad"))


@query("pattern_complexity", sql(("v_predictions",), ["""h AS (SELECT CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT) AS pattern_code, count(*) AS n FROM v_predictions GROUP BY 1)"""],
    """SELECT pattern_code, n, greatest(0.0, CASE WHEN pattern_code = 15 THEN 0.0 WHEN pattern_code & 8 <> 0 THEN 4 - bit_count(pattern_code) - 0.5
 WHEN pattern_code & 4 <> 0 THEN 4 - bit_count(pattern_code) - 0.3 ELSE 4 - bit_count(pattern_code) END)::DOUBLE AS complexity FROM h"""))
def pattern_complexity_query(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions").groupBy(pattern_code().alias("pattern_code")).agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("complexity", pattern_complexity("pattern_code"))


_TFIDF = [
    "us AS (SELECT * FROM pre WHERE length(trim(text)) > 0)",
    "wd AS (SELECT note_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM us)",
    "tf AS (SELECT note_id, ('0x' || substr(md5(w), 1, 13))::BIGINT % 256 AS pos, count(*) AS c FROM wd WHERE w <> '' GROUP BY ALL)",
    "df AS (SELECT pos, ln(((SELECT count(*) FROM us) + 1.0::DOUBLE) / (count(*) + 1)) AS idf FROM tf GROUP BY pos)",
    "tw AS (SELECT note_id, pos, c * idf AS x, sqrt(sum(c * c * idf * idf) OVER (PARTITION BY note_id)) AS norm FROM tf JOIN df USING (pos))",
    """un AS (SELECT subject_id, note_type, pos, sum(x / norm) AS total FROM tw JOIN us USING (note_id) WHERE norm > 0 GROUP BY ALL)""",
    "nn AS (SELECT subject_id, note_type, count(DISTINCT note_id) AS n FROM tw JOIN us USING (note_id) WHERE norm > 0 GROUP BY ALL)",
    "al AS (SELECT subject_id, note_type, n, unnest(range(256)) AS pos FROM nn)",
]


@query("text_embed", sql(("v_notes", "v_patients"), [*PRE_CTES, *_TFIDF], f"""SELECT p.subject_id, k.note_type, CAST(al.pos AS INT) AS pos, {r5('coalesce(total, 0.0) / n')} AS value
 FROM v_patients p CROSS JOIN (VALUES ('discharge'), ('radiology')) k(note_type) LEFT JOIN al ON p.subject_id = al.subject_id AND k.note_type = al.note_type
 LEFT JOIN un ON al.subject_id = un.subject_id AND al.note_type = un.note_type AND al.pos = un.pos"""))
def text_embed(spark, sf_dir):
    """Every entry of both note vectors of each subject; one row without entry where nothing is usable."""
    emb = embed_notes(notes(spark, sf_dir), dim=256)
    table = text_embedding_table(view(spark, sf_dir, "v_patients"), emb)
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("note_type"), V.round_vector(f"{t}_embedding", 5).alias("v")) for t in NOTE_TYPES]))
    return table.select("subject_id", kinds.alias("k")).select("subject_id", "k.note_type", F.posexplode_outer("k.v").alias("pos", "value"))
