"""Registered queries: scalar functions and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import codes as fixed
from termloom.functions import dates, text
from termloom.functions.conditions import first_known, first_match, mapped
from termloom.operators import cleaning
from termloom.operators.grading import STATUSES, with_grade_status
from termloom.operators.outcomes import changed_since_entry, graduated, sponsor_checks
from termloom.operators.rows import flag_repeated, null_outside, override_cells
from termloom.plans import sql
from termloom.plans.mart import modelling_rows
from termloom.plans.registry import query
from termloom.sources import standins
from termloom.sources.standins import table

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "j_text_clean",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(strip_accents(trim(lower(text), {WS})), '[^\x00-\x7F]', '', 'g'),
              '[^\w\s]', '', 'g') AS clean_text FROM documents""",
)
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("clean_text"))


@query(
    "j_split_head",
    rf"""SELECT doc_id, trim(split_part(split_part(split_part(lower(text), ',', 1), '/', 1), '(', 1), {WS}) AS head
         FROM documents""",
)
def split_head(spark, sf_dir):
    head = text.strip(text.head_before(F.lower("text"), ",", "/", "("))
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("head"))


@query(
    "j_blank_short_synonym",
    """SELECT event_id, CASE WHEN length(v) > 2 THEN v END AS long_value,
         CASE WHEN regexp_full_match(v, '\\s*') THEN NULL ELSE v END AS known_value,
         CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' ELSE event_type END AS kind
       FROM (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN '  ' WHEN event_id % 4 = 1 THEN 'ab'
               ELSE event_type END AS v FROM events)""",
)
def blank_short(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 4 == 0, "  ").when(F.col("event_id") % 4 == 1, "ab").otherwise(F.col("event_type"))
    return e.select("event_id", "event_type", v.alias("v")).select(
        "event_id", text.null_if_short(F.col("v")).alias("long_value"), text.blank_to_null(F.col("v")).alias("known_value"),
        mapped(F.col("event_type"), {"click": "touch", "view": "touch"}).alias("kind"),
    )


@query(
    "j_keys",
    sql.with_(
        sql.ORD,
        """SELECT o_orderkey, year || '_' || trim AS termid, id || '_' || year || '_' || trim AS id_termid,
             CASE WHEN id < 10 THEN '0' ELSE '' END || id AS padded FROM ord""",
    ),
)
def keys(spark, sf_dir):
    o = standins.orders(spark, sf_dir)
    return o.select(
        "o_orderkey", dates.term_label(F.col("year"), F.col("trim")).alias("termid"),
        text.joined_key(F.col("id"), F.col("year"), F.col("trim")).alias("id_termid"),
        text.zero_padded(F.col("id")).alias("padded"),
    )


@query(
    "j_tokens",
    rf"""SELECT conv_id, turn, CAST(len(list_filter(t, lambda x: x <> '')) AS BIGINT) AS n_tokens,
           list_filter(t, lambda x: x <> '')[1] AS first_token
         FROM (SELECT conv_id, turn, regexp_split_to_array(trim(text, {WS}), '\s+') AS t FROM conversations)""",
)
def split_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("t"))
    return c.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.try_element_at("t", F.lit(1)).alias("first_token"))


@query(
    "j_date_parts",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS year_e, CAST(month(ts) AS INTEGER) AS month_e,
         CAST(day(ts) AS INTEGER) AS day_e, CAST(isodow(ts) - 1 AS INTEGER) AS dayweek_e,
         CAST(ts AS DATE) AS select_date, strftime(ts, '%H:%M:%S') AS select_time FROM events""",
)
def date_parts(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", *[c.alias(n) for n, c in dates.date_parts(ts, "e").items()],
        dates.date_part(ts).alias("select_date"), dates.time_part(ts).alias("select_time"),
    )


@query(
    "j_parse_time",
    """SELECT o_orderkey, CAST(try_cast(s AS TIMESTAMP) AS DATE) AS parsed FROM (
         SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)""",
)
def parse(spark, sf_dir):
    s = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.to_date("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(dates.parse_time(s)).alias("parsed"))


@query(
    "j_year_repair",
    """SELECT o_orderkey, CASE WHEN year(d) < 1996 OR year(d) > 2000 THEN
           make_date(yy, month(d), least(day(d), day(last_day(make_date(yy, month(d), 1))))) ELSE d END AS date_in
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 1996 + o_custkey % 5 AS yy FROM orders)""",
)
def year_repair(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    year = (F.lit(1996) + F.col("o_custkey") % 5).cast("int")
    return o.select("o_orderkey", dates.year_repaired(F.to_date("o_orderdate"), year, 1996, 2000).alias("date_in"))


@query(
    "j_conditionals",
    """SELECT event_id, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'middle' WHEN value < 60 THEN 'high' END AS band,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
         coalesce(nullif(event_type, 'view'), 'other') AS kind, round(abs(value - 20) * 100 / 20, 4) AS off_pct FROM events""",
)
def conditionals(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", first_match([(v < 5, "low"), (v < 20, "middle"), (v < 60, "high")]).alias("band"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"),
        first_known(F.nullif("event_type", F.lit("view")), F.lit("other")).alias("kind"),
        F.round(F.abs(v - 20) * 100 / 20, 4).alias("off_pct"),
    )


@query(
    "k_grade_normalise",
    sql.with_(
        sql.GRADED,
        "SELECT grade_orig, grade, grade_status, count(*) AS n FROM graded GROUP BY 1, 2, 3",
    ),
)
def normalise(spark, sf_dir):
    graded = with_grade_status(standins.enrolment(spark, sf_dir))
    return graded.groupBy("grade_orig", "grade", "grade_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k_status",
    sql.with_(
        sql.GRADED,
        "SELECT o_orderkey, line, clave, "
        + ", ".join(
            f"""CAST(coalesce(grade_status = '{s}', false) AS INTEGER) AS {s},
                CASE WHEN grade_status = '{s}' THEN credits ELSE 0 END AS credits_{s}"""
            for s in STATUSES
        )
        + """, CAST(grade IS NULL AS INTEGER) AS grade_nan, CASE WHEN grade IS NULL THEN credits ELSE 0 END AS credits_nan
             FROM graded""",
    ),
)
def status(spark, sf_dir):
    graded = with_grade_status(standins.enrolment(spark, sf_dir))
    return graded.select(
        "o_orderkey", "line", "clave", *STATUSES, *[f"credits_{s}" for s in STATUSES], "grade_nan", "credits_nan"
    )


@query(
    "k_override",
    """SELECT p_partkey, CASE p_partkey WHEN 3 THEN 595.0 WHEN 40 THEN 1.0 ELSE p_retailprice END AS p_retailprice FROM part""",
)
def override(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return override_cells(part, "p_partkey", "p_retailprice", {3: 595.0, 40: 1.0})


SCORES = """scores AS (
  SELECT l_orderkey, l_linenumber, l_partkey, nullif(CAST(l_quantity AS INTEGER) * 20, 400) AS paa_verb,
    (l_suppkey * 7) % 900 AS paa_mat, l_linenumber * 120 - 120 AS paa_redact,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_partkey * 13) % 850 END AS paa_verb_2,
    CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_partkey * 11) % 850 END AS paa_mat_2,
    CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE (l_partkey * 3) % 850 END AS paa_redact_2 FROM lineitem)"""


def scores(spark, sf_dir):
    part, qty = F.col("l_partkey"), F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.nullif(qty * 20, F.lit(400)).alias("paa_verb"),
        ((F.col("l_suppkey") * 7) % 900).alias("paa_mat"), (F.col("l_linenumber") * 120 - 120).alias("paa_redact"),
        F.when(part % 3 != 0, (part * 13) % 850).alias("paa_verb_2"),
        F.when(part % 3 != 0, (part * 11) % 850).alias("paa_mat_2"),
        F.when(part % 5 != 0, (part * 3) % 850).alias("paa_redact_2"),
    )


@query(
    "k_range_null",
    sql.with_(
        SCORES,
        """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN paa_verb > 800 THEN NULL ELSE paa_verb END AS paa_verb,
             CASE WHEN paa_redact > 800 OR paa_redact = 0 THEN NULL ELSE paa_redact END AS paa_redact,
             CASE WHEN paa_mat < 100 OR paa_mat > 700 THEN NULL ELSE paa_mat END AS paa_mat FROM scores""",
    ),
)
def range_null(spark, sf_dir):
    limited = cleaning.limit_scores(scores(spark, sf_dir))
    return limited.select(
        "l_orderkey", "l_linenumber", "l_partkey", "paa_verb", "paa_redact",
        null_outside(F.col("paa_mat"), 100, 700).alias("paa_mat"),
    )


@query(
    "k_version_pick",
    sql.with_(
        SCORES,
        """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN b THEN paa_verb_2 ELSE paa_verb END AS paa_verb_fin,
             CASE WHEN b THEN paa_mat_2 ELSE paa_mat END AS paa_mat_fin,
             CASE WHEN b THEN paa_redact_2 ELSE paa_redact END AS paa_redact_fin
           FROM (SELECT *, coalesce(list_avg(list_filter([paa_verb_2, paa_mat_2, paa_redact_2], lambda x: x IS NOT NULL))
             > list_avg(list_filter([paa_verb, paa_mat, paa_redact], lambda x: x IS NOT NULL)), false) AS b FROM scores)""",
    ),
)
def version_pick(spark, sf_dir):
    paa = ["paa_verb", "paa_mat", "paa_redact"]
    picked = cleaning.pick_version(scores(spark, sf_dir), paa, paa)
    return picked.select("l_orderkey", "l_linenumber", "l_partkey", *[c + "_fin" for c in paa])


@query(
    "k_age_birth",
    sql.with_(
        sql.REGISTRY,
        """SELECT id, CASE WHEN ok THEN age_in END AS age_in_estim, CASE WHEN ok THEN CAST(year(dob) AS INTEGER) END AS year_birth,
             CASE WHEN ok THEN CAST(month(dob) AS INTEGER) END AS month_birth, CASE WHEN ok THEN CAST(day(dob) AS INTEGER) END AS day_birth,
             CASE WHEN ok THEN CAST(isodow(dob) - 1 AS INTEGER) END AS dayweek_birth
           FROM (SELECT id, age_in, age_in > 10 AND age_in < 70 AS ok,
                   make_date(CAST(year_in - age_in AS INTEGER), CAST(1 + id % 12 AS INTEGER), CAST(1 + id % 28 AS INTEGER)) AS dob FROM registry)
           WHERE ok""",
    ),
)
def age_birth(spark, sf_dir):
    people = standins.registry(spark, sf_dir).withColumn(
        "dob",
        F.make_date(F.col("year_in") - F.col("age_in"), (F.lit(1) + F.col("id") % 12).cast("int"), (F.lit(1) + F.col("id") % 28).cast("int")),
    )
    parts = cleaning.birth_parts(people, "dob", "age_in").dropna(subset=["year_birth"])
    return parts.select("id", "age_in_estim", "year_birth", "month_birth", "day_birth", "dayweek_birth")


@query(
    "k_mode_fill",
    sql.with_(
        sql.ORD
        + """, years AS (SELECT o_orderkey, trim, CAST(1996 + id % 5 AS INTEGER) AS year_in,
               CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM ord),
             rep AS (SELECT o_orderkey, year_in, trim, CASE WHEN year(d) < 1996 OR year(d) > 2000 THEN
                 make_date(year_in, CAST(month(d) AS INTEGER),
                   CAST(least(day(d), day(last_day(make_date(year_in, CAST(month(d) AS INTEGER), 1)))) AS INTEGER))
               ELSE d END AS d FROM years),
             modes AS (SELECT year_in, trim, d AS m FROM (
               SELECT year_in, trim, d, row_number() OVER (PARTITION BY year_in, trim ORDER BY count(*) DESC, d) AS rn
               FROM rep WHERE d IS NOT NULL GROUP BY year_in, trim, d) WHERE rn = 1)""",
        "SELECT o_orderkey, coalesce(d, m) AS date_in FROM rep LEFT JOIN modes USING (year_in, trim)",
    ),
)
def mode_fill(spark, sf_dir):
    o = standins.orders(spark, sf_dir).select(
        "o_orderkey", "trim", (F.lit(1996) + F.col("id") % 5).cast("int").alias("year_in"),
        F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate")).alias("date_in"),
    )
    repaired = cleaning.repair_entry_date(o, "date_in", "year_in", "trim", 1996, 2000, ["o_orderkey"])
    return repaired.select("o_orderkey", "date_in")


@query(
    "k_place_clean",
    rf"""SELECT id, coalesce(CASE WHEN birth_country IN ('do', 'es', 'us') THEN
             CASE coalesce(birth_city, birth_country) WHEN 'do' THEN 'ciudad republica dominicana' WHEN 'es' THEN 'ciudad espana'
               WHEN 'us' THEN 'ciudad estados unidos' ELSE coalesce(birth_city, birth_country) END
             ELSE coalesce(birth_city, birth_country) END) AS birth_city, birth_country, nationality
         FROM (SELECT id, CASE WHEN length(c) > 2 THEN c END AS birth_city, coalesce(land, nation) AS birth_country,
                 coalesce(nation, land) AS nationality
               FROM (SELECT doc_id AS id,
                   regexp_replace(regexp_replace(strip_accents(trim(split_part(split_part(split_part(lower(
                     CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END), ',', 1), '/', 1), '(', 1), {WS})),
                     '[^\x00-\x7F]', '', 'g'), '[^\w\s]', '', 'g') AS c,
                   CASE WHEN lang = 'de' THEN NULL WHEN lang = 'en' THEN 'do' WHEN lang = 'fr' THEN 'us' ELSE lang END AS land,
                   CASE WHEN doc_id % 2 = 0 THEN NULL ELSE lang END AS nation FROM documents))""",
)
def place_clean(spark, sf_dir):
    lang, doc = F.col("lang"), F.col("doc_id")
    people = table(spark, sf_dir, "documents").select(
        doc.alias("id"), F.when(doc % 3 != 0, F.col("text")).alias("birth_city"),
        F.when(lang == "en", "DOM").when(lang == "fr", "us").when(lang != "de", lang).alias("birth_country"),
        F.when(doc % 2 != 0, F.upper(lang)).alias("nationality"),
    )
    return cleaning.clean_places(people).select("id", "birth_city", "birth_country", "nationality")


@query(
    "k_city_map",
    """SELECT c_custkey AS id, CASE WHEN n_regionkey < 3 THEN lower(r_name) ELSE lower(n_name) END AS birth_city,
         NULL::VARCHAR AS birth_country, NULL::VARCHAR AS nationality
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def city_map(spark, sf_dir):
    """Cleaned places are put through an outside map; those that it does not know stay."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    known = places.filter("n_regionkey < 3").select(F.lower("n_name").alias("raw"), F.lower("r_name").alias("clean"))
    people = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "n_name", F.lit(", "), "c_mktsegment").alias("birth_city"),
        F.lit(None).cast("string").alias("birth_country"), F.lit(None).cast("string").alias("nationality"),
    )
    return cleaning.clean_places(people, city_map=known).select("id", "birth_city", "birth_country", "nationality")


@query(
    "k_modelling_rows",
    sql.with_(
        sql.SUMMARY + ", " + sql.REGISTRY,
        """SELECT r.id FROM registry r LEFT JOIN summary s ON r.id = s.id
            WHERE r.admin_type IS DISTINCT FROM 'BUILDING' AND r.program_in IS DISTINCT FROM 'FRANCE' AND s.last_program_n IS DISTINCT FROM '5-LOW'
              AND r.sex IS NOT NULL AND r.id NOT IN (SELECT id FROM panel WHERE
                (trim_order BETWEEN 2 AND 4 AND program = '1-URGENT' AND amount_cents % 3 = 0)
                OR (trim_order = 2 AND program_n = '2-HIGH' AND amount_cents % 5 = 0))""",
    ),
)
def rows_for_models(spark, sf_dir):
    """Who is modelled: excluded admissions, programmes and early terms are out, unknown ones stay, the sex is known."""
    out = {"BUILDING": fixed.EXCLUDED_ADMISSIONS[0], "FRANCE": fixed.EXCLUDED_PROGRAMMES[0], "5-LOW": fixed.EXCLUDED_TERM_PROGRAMMES[0]}

    def excluded(column: str, value: str):
        return F.when(F.col(column) == value, out[value]).otherwise(F.col(column))

    people = standins.registry(spark, sf_dir).join(standins.summary(spark, sf_dir).select("id", "last_program_n"), "id", "left")
    entities = people.select(
        "id", "sex", excluded("admin_type", "BUILDING").alias("admin_type"), excluded("program_in", "FRANCE").alias("program_in"),
        excluded("last_program_n", "5-LOW").alias("last_program"),
    )
    cents = F.col("amount_cents")
    panel = standins.panel(spark, sf_dir).select(
        "id", "trim_order",
        F.when((F.col("program") == "1-URGENT") & (cents % 3 == 0), out["5-LOW"]).otherwise(F.col("program")).alias("program"),
        F.when((F.col("program_n") == "2-HIGH") & (cents % 5 == 0), fixed.EXCLUDED_PROGRAMME_NAME).otherwise(F.col("program_n")).alias("program_name"),
    )
    return modelling_rows(entities, panel=panel).select("id")


@query(
    "k_flags",
    sql.with_(
        sql.SUMMARY + ", " + sql.REGISTRY,
        """SELECT r.id, CASE WHEN grad_date IS NULL THEN 0 ELSE 1 END AS grad,
             CASE WHEN coalesce(s.last_program_n, '') = f.program_n THEN 0 ELSE 1 END AS program_change
           FROM registry r LEFT JOIN summary s ON r.id = s.id
           LEFT JOIN (SELECT id, program_n FROM panel WHERE trim_order = 1) f ON r.id = f.id""",
    ),
)
def flags(spark, sf_dir):
    first = standins.panel(spark, sf_dir).filter("trim_order = 1").select("id", F.col("program_n").alias("program_in_n"))
    people = standins.registry(spark, sf_dir).select("id", "grad_date")
    joined = people.join(standins.summary(spark, sf_dir).select("id", "last_program_n"), "id", "left").join(first, "id", "left")
    return joined.select(
        "id", graduated(F.col("grad_date")).alias("grad"),
        changed_since_entry(F.col("last_program_n"), F.col("program_in_n")).alias("program_change"),
    )


@query(
    "k_sponsor_check",
    """SELECT o_orderkey, o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS approval_year,
         CASE WHEN year(o_orderdate) = 1995 + o_custkey % 7 THEN 0 ELSE 1 END AS comp_year,
         count(*) OVER (PARTITION BY o_custkey) > 1 AS dup_id FROM orders""",
)
def sponsor_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_orderdate")
    checked = o.withColumns(sponsor_checks(F.col("o_orderdate"), (F.lit(1995) + F.col("id") % 7).cast("int")))
    return flag_repeated(checked.drop("o_orderdate"), ["id"], ["o_orderkey"], "dup_id")


@query(
    "j_unicode_blanks",
    """SELECT doc_id, len(string_split(t, ' ')) AS n_tokens, length(t) AS n_left, CAST(0 AS BIGINT) AS n_blank
       FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents) WHERE t <> ''""",
)
def unicode_blanks(spark, sf_dir):
    """Texts with no-break and ideographic spaces in the place of blanks: they separate tokens, are
    stripped at the ends, and make no known text."""
    spaces = F.lit("\u00a0\u3000\u2009")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(spaces, F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", "\u00a0"), spaces).alias("t"), spaces.alias("b")
    ).withColumn("s", text.strip(F.col("t")))
    return docs.filter(text.blank_to_null(F.col("t")).isNotNull()).select(
        "doc_id", F.size(text.tokens(F.col("t"))).cast("long").alias("n_tokens"), F.length("s").cast("long").alias("n_left"),
        F.when(text.blank_to_null(F.col("b")).isNull(), 0).otherwise(1).cast("long").alias("n_blank"),
    )
