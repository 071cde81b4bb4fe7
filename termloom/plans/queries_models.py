"""Registered queries: encoding, imputation, components, balancing, models, cascade.

Queries that fit iterative models have no SQL; their properties are tested in ``tests``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import clean
from termloom.operators import balance, models, resample
from termloom.operators.cascade import delivery, fit_cascade
from termloom.operators.components import (
    TOLERANCE, Components, explained_table, fit_components, fit_count_components,
)
from termloom.operators.encode import area_code, condition_code, encode_labels, fit_labels, sex_code
from termloom.operators.impute import Chain, fit_class_chain, fit_linear_chain
from termloom.operators.panel import pivot_terms, year_window
from termloom.operators.search import search_adaptive
from termloom.operators.summaries import density, histogram, value_counts
from termloom.plans import sql, standin_models as data
from termloom.plans.bundle import load_bundle, manifest_table, save_bundle
from termloom.plans.registry import query
from termloom.plans.training import entry_table, search_fit_store
from termloom.session import checkpointed, scratch_path
from termloom.sources import standins
from termloom.sources.standins import table

TREE = {"maxDepth": models.DEEPEST, "minInstancesPerNode": 5}
FOREST = {k: v[0] for k, v in models.FOREST_GRID.items()}


@query(
    "l_label_encode",
    sql.with_(
        sql.TERMS,
        """, codes AS (SELECT program_n, CAST(dense_rank() OVER (ORDER BY program_n) - 1 AS INTEGER) AS code
             FROM (SELECT DISTINCT program_n FROM terms WHERE program_n IS NOT NULL))
           SELECT id, termid, t.program_n, coalesce(code, CAST((SELECT count(*) FROM codes) AS INTEGER)) AS program_code
           FROM terms t LEFT JOIN codes c ON t.program_n = c.program_n""",
    ),
)
def label_encode(spark, sf_dir):
    rows = standins.terms(spark, sf_dir).select("id", "termid", "program_n")
    return encode_labels(rows, "program_n", fit_labels(rows, "program_n"), "program_code", ["id", "termid"])


@query(
    "l_label_encode_many",
    """WITH codes AS (SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code
         FROM (SELECT DISTINCT p_name FROM part))
       SELECT p_partkey, code AS name_code FROM part JOIN codes USING (p_name)""",
)
def label_encode_many(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return encode_labels(rows, "p_name", fit_labels(rows, "p_name"), "name_code", ["p_partkey"]).drop("p_name")


@query(
    "l_shared_dictionary",
    sql.with_(
        sql.TERMS,
        """, codes AS (SELECT program, CAST(dense_rank() OVER (ORDER BY program) - 1 AS INTEGER) AS code
             FROM (SELECT DISTINCT program FROM terms))
           SELECT id, termid, coalesce(code, CAST((SELECT count(*) FROM codes) AS INTEGER)) + 1 AS program_name_code
           FROM terms t LEFT JOIN codes c ON t.program_n = c.program""",
    ),
)
def shared_dictionary(spark, sf_dir):
    rows = checkpointed(standins.terms(spark, sf_dir).select("id", "termid", "program", "program_n"))
    dictionary = fit_labels(rows, "program")
    return encode_labels(rows, "program_n", dictionary, "program_name_code", ["id", "termid"], offset=1).select(
        "id", "termid", "program_name_code"
    )


@query(
    "l_ordinal",
    sql.with_(
        sql.TERMS,
        """SELECT id, termid, CASE acad_condition WHEN 'NORMAL' THEN 3 WHEN 'SEPARADO' THEN 8 WHEN 'SUSPENDIDO' THEN 12 END
             AS condition_code,
             CASE program WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 4 END AS area_code FROM terms""",
    ),
)
def ordinal(spark, sf_dir):
    area = F.when(F.col("program") == "1-URGENT", "Ingenierías").when(F.col("program") == "2-HIGH", "SALUD")
    return standins.terms(spark, sf_dir).select(
        "id", "termid", condition_code(clean(F.col("acad_condition"))).alias("condition_code"),
        area_code(clean(area)).alias("area_code"),
    )


@query(
    "l_sex_binary",
    sql.with_(sql.REGISTRY, "SELECT id, CASE sex WHEN 'm' THEN 0 WHEN 'f' THEN 1 END AS sex FROM registry"),
)
def sex_binary(spark, sf_dir):
    return standins.registry(spark, sf_dir).select("id", sex_code(F.col("sex")).alias("sex"))


LINEAR = """base AS (SELECT o_orderkey, CAST(month(o_orderdate) AS DOUBLE) AS x,
    CASE WHEN o_orderkey % 4 <> 0 THEN round(o_totalprice * 100) % 800 END AS mat,
    CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice * 100) % 700 END AS verb,
    CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice * 100) % 600 END AS redact FROM orders),
  m1 AS (SELECT regr_slope(mat, x) AS b, regr_intercept(mat, x) AS a FROM base WHERE mat IS NOT NULL),
  s1 AS (SELECT base.* EXCLUDE (mat), trunc(coalesce(mat, a + b * x)) AS mat FROM base, m1),
  r2 AS (SELECT regr_slope(mat, x) AS mb, regr_intercept(mat, x) AS ma, regr_slope(verb, x) AS b, regr_intercept(verb, x) AS a
         FROM s1 WHERE verb IS NOT NULL),
  c2 AS (SELECT sum(verb * (mat - ma - mb * x)) / sum((mat - ma - mb * x) * (mat - ma - mb * x)) AS c FROM s1, r2 WHERE verb IS NOT NULL),
  s2 AS (SELECT s1.* EXCLUDE (verb), trunc(coalesce(verb, a + b * x + c * (mat - ma - mb * x))) AS verb FROM s1, r2, c2),
  r3 AS (SELECT regr_slope(mat, x) AS mb, regr_intercept(mat, x) AS ma, regr_slope(verb, x) AS vb, regr_intercept(verb, x) AS va,
           regr_slope(redact, x) AS b, regr_intercept(redact, x) AS a FROM s2 WHERE redact IS NOT NULL),
  o3 AS (SELECT s2.*, r3.*, mat - ma - mb * x AS m_left FROM s2, r3),
  v3 AS (SELECT sum(verb * m_left) / sum(m_left * m_left) AS vm, sum(redact * m_left) / sum(m_left * m_left) AS cm
         FROM o3 WHERE redact IS NOT NULL),
  p3 AS (SELECT o3.*, v3.*, verb - va - vb * x - vm * m_left AS v_left FROM o3, v3),
  c3 AS (SELECT sum(redact * v_left) / sum(v_left * v_left) AS cv FROM p3 WHERE redact IS NOT NULL)"""


LINEAR_RESULT = sql.with_(
    LINEAR,
    """SELECT o_orderkey, CAST(mat AS INTEGER) AS paa_mat_fin, CAST(verb AS INTEGER) AS paa_verb_fin,
         CAST(trunc(coalesce(redact, a + b * x + cm * m_left + cv * v_left)) AS INTEGER) AS paa_redact_fin FROM p3, c3""",
)
SCORES = ["paa_mat_fin", "paa_verb_fin", "paa_redact_fin"]


def gappy_scores(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100)
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.month("o_orderdate").cast("double").alias("x"),
        F.when(key % 4 != 0, cents % 800).alias(SCORES[0]), F.when(key % 5 != 0, cents % 700).alias(SCORES[1]),
        F.when(key % 7 != 0, cents % 600).alias(SCORES[2]),
    )


@query("l_impute_linear", LINEAR_RESULT)
def impute_linear(spark, sf_dir):
    rows = gappy_scores(spark, sf_dir)
    return fit_linear_chain(rows, SCORES, ["x"]).apply(rows).select("o_orderkey", *SCORES)


@query("a_model_round_trip", LINEAR_RESULT)
def model_round_trip(spark, sf_dir):
    """Fitted models are stored, loaded and give the same fills."""
    rows = gappy_scores(spark, sf_dir)
    path = scratch_path(spark, "scores")
    fit_linear_chain(rows, SCORES, ["x"]).save(path, spark)
    return Chain.load(path, spark).apply(rows).select("o_orderkey", *SCORES)


CONDITIONS = [f"trim{n:02d}_cond_code" for n in range(1, 5)]
STEPS = [[f"trim{n:02d}_amount_cents", f"trim{n:02d}_n_orders"] for n in range(1, 5)]


def first_year_wide(spark, sf_dir):
    panel = standins.panel_with_quant(spark, sf_dir).withColumn(
        "cond_code", condition_code(clean(F.col("acad_condition")))
    ).withColumn("amount_cents", F.col("amount_cents") / 1e7)
    return checkpointed(pivot_terms(year_window(panel, 1), ["amount_cents", "n_orders", "cond_code"], range(1, 5)))


@query("l_impute_condition")
def impute_condition(spark, sf_dir):
    wide = first_year_wide(spark, sf_dir)
    return fit_class_chain(wide, CONDITIONS, STEPS).apply(wide).select("id", *CONDITIONS)


@query(
    "l_impute_kept",
    sql.with_(
        sql.PANEL,
        """, wide AS (SELECT id, trim_order, acad_condition FROM quant WHERE trim_order <= 4 AND trim_quant >= 4)
           SELECT 'trim0' || trim_order AS term, count(acad_condition) AS n_known, CAST(0 AS BIGINT) AS n_changed,
             count(*) - count(acad_condition) AS n_filled, CAST(0 AS BIGINT) AS n_missing FROM wide GROUP BY trim_order""",
    ),
)
def impute_kept(spark, sf_dir):
    """What filling may and may not do: known conditions stay, every unknown one is filled."""
    wide = first_year_wide(spark, sf_dir)
    after = fit_class_chain(wide, CONDITIONS, STEPS).apply(wide).select("id", *CONDITIONS)
    both = wide.select("id", *[F.col(c).alias(f"old_{c}") for c in CONDITIONS]).join(after, "id")
    cells = both.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c[:6]).alias("term"), F.col(f"old_{c}").alias("old"), F.col(c).alias("new"))
                    for c in CONDITIONS
                ]
            )
        ).alias("c")
    ).select("c.*")
    return cells.groupBy("term").agg(
        F.count("old").alias("n_known"), F.count_if(F.col("old") != F.col("new")).alias("n_changed"),
        F.count_if(F.col("old").isNull() & F.col("new").isNotNull()).alias("n_filled"),
        F.count_if(F.col("new").isNull()).alias("n_missing"),
    )


@query("l_impute_where_null")
def impute_where_null(spark, sf_dir):
    """Stored models fill the targets that have nulls in the scored population. The second
    condition is complete there; the training rows know it and have gaps."""
    wide = first_year_wide(spark, sf_dir)
    path = scratch_path(spark, "conditions")
    fit_class_chain(wide, CONDITIONS, STEPS).save(path, spark)
    scored = wide.withColumn(CONDITIONS[1], F.coalesce(CONDITIONS[1], F.lit(3)))
    return Chain.load(path, spark).apply(scored, only_where_null=True).select("id", *CONDITIONS)


@query(
    "l_impute_where_null_kept",
    sql.with_(
        sql.PANEL,
        """, wide AS (SELECT id, trim_order, CASE acad_condition WHEN 'NORMAL' THEN 3 WHEN 'SEPARADO' THEN 8
             WHEN 'SUSPENDIDO' THEN 12 END AS code FROM quant WHERE trim_order <= 4 AND trim_quant >= 4)
           SELECT 'trim0' || trim_order AS term, count(*) AS n, CAST(0 AS BIGINT) AS n_missing,
             CASE WHEN trim_order = 2 THEN CAST(sum(coalesce(code, 3)) AS BIGINT) END AS complete_sum FROM wide GROUP BY trim_order""",
    ),
)
def impute_where_null_kept(spark, sf_dir):
    """No null stays, and the target that was complete is unchanged (the sum of its codes)."""
    filled = impute_where_null(spark, sf_dir).unpivot(["id"], CONDITIONS, "term", "code")
    return filled.groupBy(F.substring("term", 1, 6).alias("term")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("code").isNull()).alias("n_missing"), F.sum("code").alias("_sum")
    ).select("term", "n", "n_missing", F.when(F.col("term") == "trim02", F.col("_sum")).alias("complete_sum"))


@query(
    "l_course_counts",
    sql.with_(
        sql.PANEL + ", " + sql.ENROLMENT.replace(sql.ORD + ", ", ""),
        """SELECT id, count(*) AS n_courses, count(DISTINCT clave) AS n_distinct FROM enrolment
           JOIN quant USING (id, year, trim) WHERE trim_order <= 4 AND trim_quant >= 4 GROUP BY id""",
    ),
)
def course_totals(spark, sf_dir):
    counts = data.year_courses(spark, sf_dir, standins.panel_with_quant(spark, sf_dir), 1)
    return counts.groupBy("id").agg(F.sum("n").alias("n_courses"), F.count(F.lit(1)).alias("n_distinct"))


@query("l_course_components")
def course_components(spark, sf_dir):
    """Components of the course counts of the first year, learned and applied in long form."""
    panel = checkpointed(standins.panel_with_quant(spark, sf_dir))
    counts = checkpointed(data.year_courses(spark, sf_dir, panel, 1))
    keys = year_window(panel, 1).select("id").distinct()
    fitted = fit_count_components(keys, counts, data.COMPONENTS)
    return fitted.transform(keys, counts)


@query(
    "l_components_report",
    sql.with_(
        sql.PANEL + ", " + sql.ENROLMENT.replace(sql.ORD + ", ", ""),
        f"""SELECT least({data.COMPONENTS}, count(DISTINCT clave)) AS n_components, 0::BIGINT AS n_not_converged, 0::BIGINT AS n_rising,
              true AS is_share FROM enrolment JOIN quant USING (id, year, trim) WHERE trim_order <= 4 AND trim_quant >= 4""",
    ),
)
def components_report(spark, sf_dir):
    """How many components there are, how many are beyond the tolerance, and whether their shares of the variance fall."""
    panel = checkpointed(standins.panel_with_quant(spark, sf_dir))
    counts = checkpointed(data.year_courses(spark, sf_dir, panel, 1))
    fitted = fit_count_components(year_window(panel, 1).select("id").distinct(), counts, data.COMPONENTS)
    rows = [(i, e, r, (fitted.explained[i - 1] if i else 1.0)) for i, (e, r) in enumerate(zip(fitted.explained, fitted.residuals))]
    table_ = spark.createDataFrame(rows, "component int, explained double, residual double, before double")
    return table_.agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("residual") > TOLERANCE).alias("n_not_converged"),
        F.count_if(F.col("explained") > F.col("before") + 1e-12).alias("n_rising"),
        ((F.sum("explained") > 0) & (F.sum("explained") <= 1 + 1e-9)).alias("is_share"),
    )


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@query("l_pca")
def pca_scores(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    fitted = fit_components(rows, "features", 8)
    path = scratch_path(spark, "components")
    fitted.save(path, rows)
    return Components.load(path, rows).transform(rows).drop("features")


@query("l_pca_explained")
def pca_explained(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return explained_table(fit_components(rows, "features", 8), rows)


HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(
    "l_split",
    sql.with_(
        sql.LABELLED,
        f"""SELECT id, CAST(coalesce(year_desert = '1st year', false) AS INTEGER) AS y_m1,
              CASE WHEN {HASH.format("'42|' || id")} % 10000 < 2500 THEN 'test' ELSE 'train' END AS part FROM labelled""",
    ),
)
def split(spark, sf_dir):
    train, test = balance.train_test(data.people(spark, sf_dir))
    return train.select("id", "y_m1", F.lit("train").alias("part")).unionByName(
        test.select("id", "y_m1", F.lit("test").alias("part"))
    )


AXES = [f"v{i:02d}" for i in range(64)]


def one_against_rest(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("is_zero"),
        *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(AXES)],
    )


SMOTE = f"""e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label = 0 AS INTEGER) AS is_zero FROM embeddings),
  few AS (SELECT id, v FROM e WHERE is_zero = 1),
  size AS (SELECT count(*) FILTER (WHERE is_zero = 1) AS few, count(*) FILTER (WHERE is_zero = 0) AS many FROM e),
  quota AS (SELECT id, v, (many - few) // few + CASE WHEN place < (many - few) % few THEN 1 ELSE 0 END AS times
    FROM (SELECT id, v, row_number() OVER (ORDER BY {HASH.format("'42|' || id")}, id) - 1 AS place FROM few), size),
  near AS (SELECT id, list(w ORDER BY d, other) AS ends FROM (
    SELECT a.id, b.id AS other, b.v AS w, list_distance(a.v, b.v) AS d,
      row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r
    FROM few a JOIN few b ON a.id <> b.id) WHERE r <= 5 GROUP BY id),
  drawn AS (SELECT id, v, unnest(range(times)) AS j FROM quota),
  made AS (SELECT d.id, d.v, n.ends[{HASH.format("'43|' || d.id || '|' || d.j")} % len(n.ends) + 1] AS w,
      {HASH.format("'44|' || d.id || '|' || d.j")} / 4294967296.0 AS u FROM drawn d JOIN near n ON d.id = n.id)"""


@query(
    "l_smote",
    sql.with_(
        SMOTE,
        "SELECT id, is_zero, 0 AS synthetic, "
        + ", ".join(f"v[{i + 1}] AS {a}" for i, a in enumerate(AXES))
        + " FROM e UNION ALL SELECT id, 1, 1, "
        + ", ".join(f"v[{i}] + u * (w[{i}] - v[{i}])" for i in range(1, 65))
        + " FROM made",
    ),
)
def smote(spark, sf_dir):
    return balance.oversample(one_against_rest(spark, sf_dir), "is_zero", AXES)


@query(
    "l_smote_blocks",
    sql.with_(
        SMOTE,
        "SELECT id, 0 AS synthetic, " + ", ".join(f"v[{i + 1}] AS {a}" for i, a in enumerate(AXES)) + " FROM e UNION ALL SELECT id, 1, "
        + ", ".join(f"v[{i}] + u * (w[{i}] - v[{i}])" for i in range(1, 65)) + " FROM made",
    ),
)
def smote_blocks(spark, sf_dir):
    """The same rows if neighbours have to be looked for in several blocks."""
    return balance.oversample(one_against_rest(spark, sf_dir), "is_zero", AXES, block=10).select("id", "synthetic", *AXES)


AFTER = """SELECT label, n AS n_before, max(n) OVER () AS n_after FROM
  (SELECT CAST(label = 0 AS INTEGER) AS label, count(*) AS n FROM embeddings GROUP BY 1)"""


@query("l_class_distribution", AFTER)
def class_distribution(spark, sf_dir):
    rows = one_against_rest(spark, sf_dir)
    before = balance.class_distribution(rows, "is_zero").withColumnRenamed("n", "n_before")
    after = balance.class_distribution(balance.oversample(rows, "is_zero", AXES), "is_zero").withColumnRenamed("n", "n_after")
    return before.join(after, "is_zero").withColumnRenamed("is_zero", "label")


@query(
    "l_balance_variants",
    "\nUNION ALL ".join(
        f"""SELECT '{m}' AS method, toxic, max(n) OVER () AS n FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)"""
        for m in balance.METHODS
    ),
)
def balance_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words"))
    rows = checkpointed(table(spark, sf_dir, "labels").join(docs, "doc_id", "left").fillna(0))
    parts = [
        balance.class_distribution(
            balance.oversample(rows, "toxic", ["n_chars", "n_words"], "doc_id", method=m), "toxic"
        ).select(F.lit(m).alias("method"), "toxic", "n")
        for m in balance.METHODS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


BALANCED = SMOTE + """, grown AS (
    SELECT id, is_zero, 0 AS synthetic, v FROM e UNION ALL
    SELECT id, 1, 1, list_transform(list_zip(v, w), lambda p: p[1] + u * (p[2] - p[1])) FROM made),
  rows AS (SELECT row_number() OVER (ORDER BY synthetic, id, v) - 1 AS r, id, is_zero, synthetic, v FROM grown),
  placed AS (SELECT *, min(r) OVER (PARTITION BY v) AS place FROM rows),
  pairs AS (SELECT a.r, a.is_zero, b.r AS other, b.is_zero AS other_is_zero,
      row_number() OVER (PARTITION BY a.r ORDER BY list_distance(a.v, b.v), b.place, a.is_zero <> b.is_zero, b.r) AS nth,
      row_number() OVER (PARTITION BY a.r ORDER BY list_distance(a.v, b.v), b.r) AS by_row
    FROM placed a JOIN placed b ON a.r <> b.r)"""


@query(
    "l_enn_removed",
    sql.with_(
        BALANCED,
        """SELECT r AS "row", id, is_zero, synthetic FROM rows WHERE r IN
             (SELECT r FROM pairs WHERE nth <= 3 GROUP BY r HAVING bool_or(is_zero <> other_is_zero))""",
    ),
)
def enn_removed(spark, sf_dir):
    """Rows of the balanced table whose three nearest are not all of their class."""
    rows = resample.numbered(balance.oversample(one_against_rest(spark, sf_dir), "is_zero", AXES), AXES)
    gone = resample.enn_removed(rows, "is_zero", AXES, resample.ROW)
    return rows.join(gone.hint("merge"), resample.ROW, "left_semi").select(resample.ROW, "id", "is_zero", "synthetic")


@query(
    "l_tomek_links",
    """WITH e AS (SELECT vec_id AS id, label % 2 AS odd, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
         nearest AS (SELECT a.id, a.odd, b.id AS other, b.odd AS other_odd,
             row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS nth FROM e a JOIN e b ON a.id <> b.id)
       SELECT a.id, a.other FROM nearest a JOIN nearest b ON a.other = b.id AND b.other = a.id
       WHERE a.nth = 1 AND b.nth = 1 AND a.odd <> a.other_odd AND a.id < a.other""",
)
def tomek_links(spark, sf_dir):
    """Mutual nearest vectors of different classes."""
    rows = one_against_rest(spark, sf_dir).drop("is_zero").join(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("odd")).hint("merge"), "id"
    )
    return resample.tomek_links(rows, "odd", AXES)


@query(
    "l_balance_cleaned",
    sql.with_(
        BALANCED,
        """, enn AS (SELECT r FROM pairs WHERE nth <= 3 GROUP BY r HAVING bool_or(is_zero <> other_is_zero)),
           links AS (SELECT a.r FROM pairs a JOIN pairs b ON a.other = b.r AND b.other = a.r
             WHERE a.by_row = 1 AND b.by_row = 1 AND a.is_zero <> a.other_is_zero)
           SELECT 'smote' AS method, is_zero, synthetic, count(*) AS n, sum(r)::BIGINT AS row_sum FROM rows GROUP BY ALL
           UNION ALL SELECT 'smote_enn', is_zero, synthetic, count(*), sum(r)::BIGINT FROM rows
             WHERE r NOT IN (SELECT r FROM enn) GROUP BY ALL
           UNION ALL SELECT 'smote_tomek', is_zero, synthetic, count(*), sum(r)::BIGINT FROM rows
             WHERE r NOT IN (SELECT r FROM links) GROUP BY ALL""",
    ),
)
def balance_cleaned(spark, sf_dir):
    """What each way of balancing keeps: rows per class and kind, and the sum of their numbers."""
    parts = [
        resample.balanced(one_against_rest(spark, sf_dir), "is_zero", AXES, method=m)
        .groupBy("is_zero", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.sum(resample.ROW).alias("row_sum"))
        .select(F.lit(m).alias("method"), "is_zero", "synthetic", "n", "row_sum")
        for m in balance.METHODS
    ]
    return reduce(DataFrame.unionByName, parts)


def entry_rows(spark, sf_dir):
    """Entry features of the closed entities, split for training and test."""
    closed, _ = data.closed_and_open(data.people(spark, sf_dir))
    rows, _ = entry_table(closed, data.NUMERIC, data.CATEGORIES, data.TARGETS)
    return balance.train_test(checkpointed(rows))


@query("l_tree")
def tree(spark, sf_dir):
    train, test = entry_rows(spark, sf_dir)
    model = models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "tree", **TREE)
    return models.confusion(models.score(model, test, "pred", "prob"), "y_two", "pred")


@query("l_forest")
def forest(spark, sf_dir):
    train, test = entry_rows(spark, sf_dir)
    model = models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "forest", **FOREST)
    return models.score(model, test, "pred", "prob").select("id", "y_two", "pred", "prob")


TEST_ROWS = sql.with_(
    sql.LABELLED,
    f""", test AS (SELECT id, CASE y WHEN 'graduate' THEN 0 WHEN 'voluntary desertion' THEN 1
           WHEN 'involuntary desertion' THEN 1 END AS y_two FROM labelled
         WHERE y NOT IN ('active', 'suspended') AND {HASH.format("'42|' || id")} % 10000 < 2500)
       SELECT CAST(y_two AS INTEGER) AS y_two, count(*) AS n, CAST(0 AS BIGINT) AS n_no_class, CAST(0 AS BIGINT) AS n_no_risk
       FROM test GROUP BY y_two""",
)


def judged_rows(scored: DataFrame) -> DataFrame:
    """Scored rows per class, those without a known class and those whose risk is no probability."""
    return scored.groupBy(F.col("y_two").cast("int").alias("y_two")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(F.col("pred").isin(0, 1), F.lit(False))).alias("n_no_class"),
        F.count_if(~F.coalesce(F.col("prob").between(0, 1), F.lit(False))).alias("n_no_risk"),
    )


@query("l_forest_rows", TEST_ROWS)
def forest_rows(spark, sf_dir):
    """What a forest may not do: lose or repeat a test row, or give no class or risk."""
    return judged_rows(forest(spark, sf_dir))


@query("l_retrain_rows", TEST_ROWS)
def retrain_rows(spark, sf_dir):
    """The same of a stored model that was fitted again."""
    _, test = entry_rows(spark, sf_dir)
    return judged_rows(retrain(spark, sf_dir).join(test.select("id", "y_two"), "id"))


@query("l_tree_search")
def tree_search(spark, sf_dir):
    """All points of the tree grid that Spark can reach, two folds each, most promising first."""
    train, _ = entry_rows(spark, sf_dir)
    trials = search_adaptive(train, data.ENTRY_FEATURES, "y_two", n_iter=150)
    return models.trial_table(trials, train).drop("mean_fit_time")


@query("l_forest_search")
def forest_search(spark, sf_dir):
    """Successive halving over the forest grid: 200 and 300 trees, seven folds."""
    train, _ = entry_rows(spark, sf_dir)
    return models.trial_table(models.search_forest(train, data.ENTRY_FEATURES, "y_two"), train).drop("mean_fit_time")


@query("l_search_fit")
def search_fit(spark, sf_dir):
    """Search, fit, store, load and evaluate in one job, on the rows as they are and on balanced ones."""
    train, test = entry_rows(spark, sf_dir)
    parts = []
    for balanced in (False, True):
        job = search_fit_store(
            train, test, data.ENTRY_FEATURES, "y_two", scratch_path(spark, "searched"), balanced=balanced
        )
        parts.append(job.row().withColumn("balanced", F.lit(balanced)))
    return parts[0].unionByName(parts[1])


TRIALS = """SELECT p_brand || '/' || p_type AS params, CAST(count(*) % 7 AS DOUBLE) - 3.0 AS mean_test_score,
  CAST(sum(p_size) AS DOUBLE) AS mean_fit_time FROM part GROUP BY p_brand, p_type"""


@query(
    "g_best_trial",
    f"""SELECT params, abs(mean_test_score) AS mean_test_score, mean_fit_time FROM ({TRIALS})
        ORDER BY abs(mean_test_score) DESC, mean_fit_time, params LIMIT 1""",
)
def best_of_trials(spark, sf_dir):
    trials = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("params")).agg(
        ((F.count(F.lit(1)) % 7).cast("double") - 3.0).alias("mean_test_score"),
        F.sum("p_size").cast("double").alias("mean_fit_time"),
    )
    return models.best_trial(trials)


@query(
    "l_evaluate",
    """WITH p AS (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
                    CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice < 320000 THEN 1 ELSE 2 END AS p FROM orders),
       c AS (SELECT k, count(*) FILTER (WHERE y = k) AS r, count(*) FILTER (WHERE p = k) AS s,
               count(*) FILTER (WHERE y = k AND p = k) AS h FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY k)
       SELECT round(sum(h) / sum(r), 8) AS accuracy, round(sum(r * 2.0 * h / (r + s)) / sum(r), 8) AS f1_score,
         round(sum(r * 1.0 * h / s) / sum(r), 8) AS "precision", round(sum(r * 1.0 * h / r) / sum(r), 8) AS recall FROM c""",
)
def evaluation(spark, sf_dir):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("y"),
        F.when(price < 150000, 0).when(price < 320000, 1).otherwise(2).alias("p"),
    )
    result = models.evaluate(rows, "y", "p")
    return result.select(*[F.round(c, 8).alias(c) for c in result.columns])


@query(
    "l_confusion",
    """SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS label,
         CAST(CASE WHEN o_totalprice < 250000 THEN 0 ELSE 1 END AS DOUBLE) AS prediction, count(*) AS n
       FROM orders GROUP BY 1, 2""",
)
def confusion(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("y"),
        F.when(F.col("o_totalprice") < 250000, 0).otherwise(1).alias("p"),
    )
    return models.confusion(rows, "y", "p")


@query("l_score_distribution")
def score_distribution(spark, sf_dir):
    train, test = entry_rows(spark, sf_dir)
    model = models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "tree", **TREE)
    return histogram(models.score(model, test, "pred", "prob"), "prob", 20)


@query("l_score_density")
def score_density(spark, sf_dir):
    """The smoothed curve over the distribution of the risk."""
    train, test = entry_rows(spark, sf_dir)
    model = models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "tree", **TREE)
    return density(models.score(model, test, "pred", "prob"), "prob")


@query("l_importance")
def importance(spark, sf_dir):
    train, _ = entry_rows(spark, sf_dir)
    return models.importances(models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "tree", **TREE), train)


@query(
    "l_append_prob",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount + l_tax, 6) AS risk FROM lineitem""",
)
def append_prob(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(models.risk(F.array(1 - d - t, d, t)), 6).alias("risk")
    )


@query("l_targets_compare")
def targets_compare(spark, sf_dir):
    """The general target against the one of the year, on the same rows."""
    train, test = entry_rows(spark, sf_dir)
    parts = []
    for target in ("y_two", "y_m1"):
        model = models.fit_classifier(train, data.ENTRY_FEATURES, target, "tree", **TREE)
        scored = models.score(model, test, "pred", "prob")
        parts.append(models.evaluate(scored, target, "pred").withColumn("target", F.lit(target)))
    return parts[0].unionByName(parts[1])


@query("l_feature_sets")
def feature_sets(spark, sf_dir):
    """Year 2 with the risk of year 1 against all entry features."""
    rows, stages, train, _, _ = data.cascade_data(spark, sf_dir, year_nos=(1,))
    entry, year2 = train[0], train[1]
    first = models.fit_classifier(balance.train_test(entry)[0], data.ENTRY_FEATURES, "y_m1", "tree", **TREE)
    prob = models.score(first, entry, "pred1", "prob1").select("id", "prob1", *data.ENTRY_FEATURES)
    joined = checkpointed(year2.join(prob, "id", "left").dropna(subset=["prob1"]))
    fit_on, test = balance.train_test(joined)
    parts = []
    for name, more in (("risk", ["prob1"]), ("all", data.ENTRY_FEATURES)):
        model = models.fit_classifier(fit_on, [*stages[1].features, *more], "y_m2", "tree", **TREE)
        scored = models.score(model, test, "pred", "prob")
        parts.append(models.evaluate(scored, "y_m2", "pred").withColumn("features", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("l_retrain")
def retrain(spark, sf_dir):
    """A stored model is loaded and fitted again with its own parameters and renamed features."""
    train, test = entry_rows(spark, sf_dir)
    path = models.save_model(
        models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "tree", **TREE), scratch_path(spark, "tree")
    )
    renamed = {"nation": "program_in_code"}
    again = models.refit(models.load_model(path), train.withColumnsRenamed(renamed), "y_two", renamed)
    return models.score(again, test.withColumnsRenamed(renamed), "pred", "prob").select("id", "pred", "prob")


@query("l_cascade")
def cascade(spark, sf_dir):
    """Four yearly models, each on the rows as they are and on balanced ones."""
    _, stages, train, _, _ = data.cascade_data(spark, sf_dir)
    parts = []
    for balanced in (False, True):
        _, metrics = fit_cascade([replace(s, balanced=balanced) for s in stages], train)
        parts += [m.withColumn("balanced", F.lit(balanced)) for m in metrics]
    return reduce(DataFrame.unionByName, parts)


DELIVERED = [
    "id", "age_in", "program_in", "year_in", "trim_in", "sex", "pred_year1", "prob_year1", "pred_year2", "prob_year2",
    "pred_year3", "prob_year3",
]


def stored_bundle(spark, sf_dir) -> str:
    """Train on the closed entities and store the bundle; only its path goes on."""
    # the last year is not scored: its label is not open any more
    path = scratch_path(spark, "bundle")
    save_bundle(spark, data.fit_bundle(spark, sf_dir, (1, 2)), path)
    return path


@query("l_score_active")
def score_active(spark, sf_dir):
    """The entities without a final label, scored from a stored bundle and delivered with attributes."""
    return delivery(data.score_open(spark, sf_dir, stored_bundle(spark, sf_dir)), DELIVERED)


@query(
    "l_score_active_pattern",
    sql.with_(
        sql.LABELLED,
        """SELECT id, true AS scored_year1, trim_quant >= 4 AS scored_year2, trim_quant >= 8 AS scored_year3, 0 AS n_no_probability
           FROM labelled WHERE y = 'active'""",
    ),
)
def score_active_pattern(spark, sf_dir):
    """Who is scored: every open entity for the first year, and for a later one those that completed the year before."""
    scored = score_active(spark, sf_dir)
    odd = [F.when(F.col(f"prob_year{n}").isNotNull() & ~F.col(f"prob_year{n}").between(0, 1), 1).otherwise(0) for n in (1, 2, 3)]
    return scored.select(
        "id", *[(F.col(f"pred_year{n}").isNotNull() & F.col(f"prob_year{n}").isNotNull()).alias(f"scored_year{n}") for n in (1, 2, 3)],
        (odd[0] + odd[1] + odd[2]).alias("n_no_probability"),
    )


@query("l_bundle_manifest")
def bundle_manifest(spark, sf_dir):
    """Stages and features of every version under a path, after two trainings."""
    bundle, path = data.fit_bundle(spark, sf_dir, (1,)), scratch_path(spark, "bundle")
    save_bundle(spark, bundle, path)
    save_bundle(spark, load_bundle(spark, path), path)
    return manifest_table(spark, path)


@query("l_predicted_counts")
def predicted_counts(spark, sf_dir):
    train, test = entry_rows(spark, sf_dir)
    model = models.fit_classifier(train, data.ENTRY_FEATURES, "y_two", "tree", **TREE)
    return value_counts(models.score(model, test, "y_y1_pred", "y_y1_prob"), "y_y1_pred")
