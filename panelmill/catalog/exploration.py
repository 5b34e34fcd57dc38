"""Coverage, rankings, profiles, drift, and the cleaning operators on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.catalog.common import (
    MARKET, PRODUCER, keyed, query, rounded, sql_clean, sql_key, sql_rounded, sql_title,
)
from panelmill.functions import dates, numbers, text
from panelmill.operators import grouping, monitoring, ranking, summaries
from panelmill.plans.legacy import clean_frame
from panelmill.sources import driver_tables as dt
from panelmill.sources import files

# ---- coverage and rankings ------------------------------------------------------------------


def _coverage(spark, sf):
    """Counts of both price sources, by cleaned product and province."""
    parts = [
        ranking.source_counts(dt.market_prices(spark, sf).select("producto", "provincia"), "mercados"),
        ranking.source_counts(dt.producer_prices(spark, sf).select("producto", "provincia"), "productor"),
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.groupBy("fuente", "producto", "provincia").agg(F.sum("rows__n").alias("registros"))


def product_summary(spark, sf):
    return summaries.per_source_and_total(summaries.product_summary, _coverage(spark, sf))


def province_summary(spark, sf):
    return summaries.per_source_and_total(summaries.province_summary, _coverage(spark, sf))


def coverage_totals(spark, sf):
    return summaries.per_source_and_total(summaries.coverage_totals, _coverage(spark, sf))


def top_products(spark, sf):
    """The ten products with most rows over both sources."""
    counts = _coverage(spark, sf)
    order = [F.desc("registros"), F.desc("provincias_distintas"), F.asc("producto")]
    return summaries.top_rows(summaries.product_summary(counts), order, 10).select("producto", "registros", "provincias_distintas")


def _ranked(spark, sf):
    producer = ranking.source_counts(dt.producer_prices(spark, sf).select("producto", "provincia"), "productor")
    market = ranking.source_counts(dt.market_prices(spark, sf).select("producto", "provincia"), "mercados")
    return ranking.joined_counts(
        ranking.product_province_counts(producer, "productor"), ranking.product_province_counts(market, "mercados")
    )


def product_province_counts(spark, sf):
    return _ranked(spark, sf)


def product_ranking(spark, sf):
    return ranking.shared_products(_ranked(spark, sf))


def province_ranking(spark, sf):
    merged = _ranked(spark, sf)
    return ranking.influential_provinces(merged, ranking.shared_products(merged))


def usual_priority(spark, sf):
    """Most common order priority per customer."""
    return grouping.most_common(dt.table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "usual")


# ---- profiles ----------------------------------------------------------------------------------

PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def frame_profile(spark, sf):
    return rounded(summaries.frame_profile(dt.table(spark, sf, "lineitem").select(*PROFILED)), 4)


def events_profile(spark, sf):
    """Events with their parsed payload, which is missing in places."""
    events = dt.table(spark, sf, "events").select(
        "event_type", "value", F.get_json_object("props", "$.k").try_cast("double").alias("k")
    )
    return rounded(summaries.frame_profile(events), 4)


def null_profile(spark, sf):
    orders = dt.table(spark, sf, "customer").join(
        dt.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    return summaries.null_counts(orders, ["c_custkey", "c_acctbal", "o_orderkey", "o_orderstatus", "o_totalprice"])


def correlation_matrix(spark, sf):
    return rounded(summaries.correlation_matrix(dt.table(spark, sf, "lineitem"), MEASURES), 6)


def distinct_rows(spark, sf):
    pairs = dt.table(spark, sf, "documents").select(F.col("lang").alias(" Lang Code"), F.col("source").alias("Source"))
    return clean_frame(pairs)


# ---- drift -----------------------------------------------------------------------------------------


def drift_ks_psi(spark, sf):
    """First against second half of the month of events."""
    events = dt.table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double"))
    middle = F.lit("2024-01-16").cast("date")
    first, second = events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)
    return rounded(monitoring.drift_report(first, second, ["value", "user_id", "hour"]), 5)


def price_drift(spark, sf):
    """Line items shipped before 1998 against later ones."""
    lines = dt.table(spark, sf, "lineitem")
    cut = F.lit("1998-01-01").cast("date")
    report = monitoring.drift_report(lines.where(F.col("l_shipdate") < cut), lines.where(F.col("l_shipdate") >= cut), MEASURES)
    return rounded(report, 5)


# ---- cleaning --------------------------------------------------------------------------------------


def clean_text_keys(spark, sf):
    docs = dt.table(spark, sf, "documents").withColumns(
        {"cleaned": text.clean_text(F.col("text")), "key": text.match_key(F.col("text"))}
    )
    return docs.select(
        "doc_id", F.md5("cleaned").alias("cleaned"), F.md5(text.title_case(F.col("cleaned"))).alias("titled"),
        F.md5("key").alias("key"), F.length("key").alias("key_chars"), F.md5(text.key_slug(F.col("key"))).alias("slug"),
    )


def clean_text_keys_wide(spark, sf):
    """Match keys through the full compatibility decomposition."""
    docs = dt.table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(text.match_key(F.col("text"), wide=True)).alias("key"))


def numeric_parse(spark, sf):
    """Locale price texts in several spellings, per line item."""
    price = F.col("l_extendedprice").cast("string")
    spelled = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("$"), F.replace(price, F.lit("."), F.lit(","))))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit(" "), price, F.lit(" ")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("1."), F.replace(price, F.lit("."), F.lit(","))))
        .when(F.col("l_linenumber") == 4, F.lit("n/d"))
        .otherwise(price)
    )
    lines = dt.table(spark, sf, "lineitem").withColumn("price_text", spelled)
    return lines.select(
        "l_orderkey", "l_linenumber", numbers.locale_number(F.col("price_text")).alias("locale"),
        numbers.plain_number(F.col("price_text")).alias("plain"),
        (F.floor(numbers.box_to_kg(F.col("l_extendedprice")) * 1e6 + 0.50137) / 1e6).alias("kg"),
    )


MONTH_TEXTS = ["Enero", " FEB ", "marzo", "abr", "MAYO", "jun", "julio", "Ago", "sept", "octubre", "nov", "diciembre"]


def month_parse(spark, sf):
    """Order months written in Spanish and read back; `sept` is not a known month."""
    names = F.array(*[F.lit(m) for m in MONTH_TEXTS])
    year = F.when(F.col("o_orderstatus") == "P", F.lit("x")).otherwise(F.year("o_orderdate").cast("string"))
    orders = dt.table(spark, sf, "orders").select(
        "o_orderkey", year.alias("ano"), F.element_at(names, F.month("o_orderdate")).alias("mes")
    )
    return dates.add_month_date(orders).select("o_orderkey", "mes_num", "fecha")


def blank_names(spark, sf):
    """Words of each language that vanish or survive the blank-name filter."""
    tokens = dt.table(spark, sf, "documents").select(
        "lang", F.explode(F.split("text", r"\n")).alias("producto")
    ).withColumn("provincia", F.col("lang"))
    kept = ranking.prepare_source(tokens, "documents")
    return kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.length("producto")).alias("chars")
    )


def document_lines_header(spark, sf):
    """Every document as a file: its header is the first of 20 lines with three filled cells."""
    lines = dt.table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.lit(0).alias("block"),
        F.posexplode(F.split("text", r"\n")).alias("line", "value"),
    )
    headers = files.header_by_width(lines)
    profile = files.file_profile(lines, headers)
    return headers.join(profile, "file", "left").select(
        "file", F.col("header_line").cast("long").alias("header_line"), F.md5("header").alias("header"),
        F.coalesce("filas", F.lit(0)).alias("filas"), F.coalesce("columnas", F.lit(0)).cast("long").alias("columnas"),
    )


def source_names(spark, sf):
    """Page addresses whose last part is not a summary, chart or index."""
    pages = dt.table(spark, sf, "pages")
    name = files.file_name(F.col("url"))
    return pages.select("page_id", name.alias("name"), files.valid_source_name(name).alias("valid"))


def group_medians(spark, sf):
    """Exact quantiles per ship month and return flag."""
    lines = dt.table(spark, sf, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    shares = {"q10": 0.1, "q50": 0.5, "q95": 0.95}
    return rounded(grouping.exact_quantiles(lines, ["month", "l_returnflag"], "l_extendedprice", shares), 4)


QUERIES = {
    f.__name__: f
    for f in (
        product_summary, province_summary, coverage_totals, top_products, product_province_counts, product_ranking,
        province_ranking, usual_priority, frame_profile, events_profile, null_profile, correlation_matrix, distinct_rows,
        drift_ks_psi, price_drift, clean_text_keys, clean_text_keys_wide, numeric_parse, month_parse, blank_names,
        document_lines_header, source_names, group_medians,
    )
}

SOURCES = f"""{MARKET},{PRODUCER},{keyed('market_prices')},{keyed('producer_prices')},
both_sources AS (
  SELECT 'mercados' AS fuente, producto, provincia FROM market_prices_k
  UNION ALL SELECT 'productor', producto, provincia FROM producer_prices_k
  UNION ALL SELECT 'consolidado', producto, provincia FROM market_prices_k
  UNION ALL SELECT 'consolidado', producto, provincia FROM producer_prices_k)"""

MERGED = f"""{MARKET},{PRODUCER},{keyed('market_prices')},{keyed('producer_prices')},
pc AS (SELECT product_key AS producto_key, provincia_key, min(producto) AS producto_productor, min(provincia) AS provincia_productor,
              count(*) AS registros_productor FROM producer_prices_k GROUP BY 1, 2),
mc AS (SELECT product_key AS producto_key, provincia_key, min(producto) AS producto_mercados, min(provincia) AS provincia_mercados,
              count(*) AS registros_mercados FROM market_prices_k GROUP BY 1, 2),
merged AS (SELECT producto_key, provincia_key, producto_productor, provincia_productor,
                  coalesce(registros_productor, 0) AS registros_productor, producto_mercados, provincia_mercados,
                  coalesce(registros_mercados, 0) AS registros_mercados
           FROM pc FULL JOIN mc USING (producto_key, provincia_key)),
products AS (
  SELECT producto_key, coalesce(min(producto_productor), '') AS producto_productor, coalesce(min(producto_mercados), '') AS producto_mercados,
         sum(registros_productor)::BIGINT AS registros_productor, sum(registros_mercados)::BIGINT AS registros_mercados,
         count(*) FILTER (registros_productor > 0) AS provincias_productor, count(*) FILTER (registros_mercados > 0) AS provincias_mercados,
         count(*) FILTER (registros_productor > 0 AND registros_mercados > 0) AS provincias_en_ambas,
         count(DISTINCT provincia_key) AS provincias_union
  FROM merged GROUP BY 1 HAVING sum(registros_productor) > 0 AND sum(registros_mercados) > 0)"""


def _score(overlap: str) -> str:
    return (
        "registros_productor + registros_mercados + 2 * least(registros_productor, registros_mercados)"
        f" + 25 * {overlap}"
    )


def _long_sql(table: str, columns: list[str], kind: str = "DOUBLE") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS {kind}) AS value FROM {table}" for c in columns)


def _profile_sql(table: str, numeric: dict[str, str], texts: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count({c}) AS count, {sql_rounded(f'avg({c})', 4)} AS mean,
  {sql_rounded(f'stddev_samp({c})', 4)} AS std, {sql_rounded(f'min({c})', 4)} AS min, {sql_rounded(f'max({c})', 4)} AS max,
  {", ".join(f"{sql_rounded(f'quantile_cont({c}, 0.{q})', 4)} AS q{q}" for q in (25, 50, 75))},
  NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM {table}"""
        for c, t in numeric.items()
    ] + [
        f"""SELECT '{c}', 'string', (SELECT count(*) FROM {table}), sum(n)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  count(*), first({c} ORDER BY n DESC, {c}), max(n) FROM (SELECT {c}, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) v"""
        for c in texts
    ]
    return "\nUNION ALL ".join(parts)


def _drift_sql(ctes: str) -> str:
    """KS and PSI from (column, value, cur) rows, cur being 0 for the reference and 1 for the current frame."""
    terms = " + ".join(f"{2 * (-1) ** (j - 1)} * exp(-2.0::DOUBLE * {j * j} * s * s)" for j in range(1, 101))
    return f"""WITH {ctes},
tot AS (SELECT "column", count(*) FILTER (cur = 0) AS m, count(*) FILTER (cur = 1) AS k FROM cells GROUP BY 1),
cum AS (SELECT "column", sum(r) OVER w AS r, sum(c) OVER w AS c FROM (
    SELECT "column", value, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c FROM cells GROUP BY 1, 2) v
  WINDOW w AS (PARTITION BY "column" ORDER BY value)),
ks AS (SELECT "column", m, k, max(abs(r / m - c / k)) AS ks, max(abs(r / m - c / k)) * sqrt(m * k / (m + k)) AS s
       FROM cum JOIN tot USING ("column") GROUP BY 1, 2, 3),
edges AS (SELECT "column", quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM cells WHERE cur = 0 GROUP BY 1),
bins AS (SELECT "column", len(list_filter(e, lambda x: x < value)) AS bin, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c
         FROM cells JOIN edges USING ("column") GROUP BY 1, 2),
psi AS (SELECT "column", sum((greatest(c / k, 1e-4) - greatest(r / m, 1e-4)) * ln(greatest(c / k, 1e-4) / greatest(r / m, 1e-4))) AS psi
        FROM bins JOIN tot USING ("column") GROUP BY 1),
p AS (SELECT *, CASE WHEN s < 0.2 THEN 1 ELSE greatest(0, least(1, {terms})) END AS pv FROM ks JOIN psi USING ("column"))
SELECT "column", m AS n_reference, k AS n_current, {sql_rounded('ks')} AS ks, {sql_rounded('pv')} AS ks_p_value,
       {sql_rounded('psi')} AS psi, pv < 0.05 AS drifted, {sql_rounded('avg((pv < 0.05)::INT) OVER ()')} AS drifted_share FROM p"""


MONTH_CASE = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN {i}" for i in range(1, 13) if i != 9) + " END"
PRICE_TEXT = "CAST(l_extendedprice AS VARCHAR)"
CELLS = "len(list_filter(string_split(value, ','), lambda c: trim(c) <> ''))"

ORACLES = {
    "product_summary": query(
        SOURCES,
        """SELECT fuente, producto, count(*) AS registros, count(DISTINCT provincia) AS provincias_distintas,
       string_agg(DISTINCT provincia, ' | ' ORDER BY provincia) AS provincias FROM both_sources GROUP BY 1, 2""",
    ),
    "province_summary": query(
        SOURCES,
        "SELECT fuente, provincia, count(*) AS registros, count(DISTINCT producto) AS productos_distintos FROM both_sources GROUP BY 1, 2",
    ),
    "coverage_totals": query(
        SOURCES,
        """SELECT fuente, count(*) AS registros, count(DISTINCT producto) AS productos_distintos,
       count(DISTINCT provincia) AS provincias_distintas FROM both_sources GROUP BY 1""",
    ),
    "top_products": query(
        SOURCES,
        """SELECT producto, count(*) AS registros, count(DISTINCT provincia) AS provincias_distintas
FROM both_sources WHERE fuente = 'consolidado' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""",
    ),
    "product_province_counts": query(MERGED, "SELECT * FROM merged"),
    "product_ranking": query(
        MERGED,
        f"""SELECT *, CASE WHEN producto_productor <> '' THEN producto_productor ELSE producto_mercados END AS producto_recomendado,
       registros_productor + registros_mercados AS registros_total,
       least(registros_productor, registros_mercados) AS registros_balance, {_score('provincias_en_ambas')} AS score_modelado
FROM products""",
    ),
    "province_ranking": query(
        f"""{MERGED},
shared AS (SELECT m.*, coalesce(producto_productor, producto_mercados) AS producto, coalesce(provincia_productor, provincia_mercados) AS provincia
           FROM merged m WHERE producto_key IN (SELECT producto_key FROM products)),
tops AS (SELECT provincia_key, string_agg(producto, ' | ' ORDER BY t DESC, producto) AS top_5_productos FROM (
    SELECT provincia_key, producto, sum(registros_productor + registros_mercados) AS t FROM shared GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY provincia_key ORDER BY t DESC, producto) <= 5) x GROUP BY 1),
rolled AS (SELECT provincia_key, min(provincia) AS provincia, sum(registros_productor)::BIGINT AS registros_productor,
                  sum(registros_mercados)::BIGINT AS registros_mercados, count(DISTINCT producto_key) AS productos_distintos,
                  count(*) FILTER (registros_productor > 0 AND registros_mercados > 0) AS productos_en_ambas
           FROM shared GROUP BY 1)""",
        f"""SELECT *, registros_productor + registros_mercados AS registros_total,
       least(registros_productor, registros_mercados) AS registros_balance, {_score('productos_en_ambas')} AS score_influencia
FROM rolled JOIN tops USING (provincia_key)""",
    ),
    "usual_priority": """SELECT o_custkey, first(o_orderpriority ORDER BY n DESC, o_orderpriority) AS usual
FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) c GROUP BY 1""",
    "frame_profile": _profile_sql("lineitem", {c: "double" for c in MEASURES}, ["l_returnflag", "l_linestatus"]),
    "events_profile": "WITH ev AS (SELECT event_type, value, TRY_CAST(props->>'$.k' AS DOUBLE) AS k FROM events)\n"
    + _profile_sql("ev", {"value": "double", "k": "double"}, ["event_type"]),
    "null_profile": "WITH j AS (SELECT * FROM customer LEFT JOIN orders ON c_custkey = o_custkey)\n"
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM j"
        for c in ("c_custkey", "c_acctbal", "o_orderkey", "o_orderstatus", "o_totalprice")
    ),
    "correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {sql_rounded(f'corr({a}, {b})', 6)} AS corr FROM lineitem" for a in MEASURES for b in MEASURES
    ),
    "distinct_rows": "SELECT DISTINCT lang AS lang_code, source FROM documents",
    "drift_ks_psi": _drift_sql(
        "cells AS ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS \"column\", CAST({x} AS DOUBLE) AS value, (ts >= TIMESTAMP '2024-01-16')::INT AS cur FROM events WHERE {x} IS NOT NULL"
            for n, x in (("value", "value"), ("user_id", "user_id"), ("hour", "hour(ts)"))
        )
        + ")"
    ),
    "price_drift": _drift_sql(
        "cells AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {c} AS value, (l_shipdate >= TIMESTAMP '1998-01-01')::INT AS cur FROM lineitem" for c in MEASURES
        )
        + ")"
    ),
    "clean_text_keys": f"""WITH k AS (SELECT doc_id, text, {sql_key('text')} AS key FROM documents)
SELECT doc_id, md5({sql_clean('text')}) AS cleaned, md5({sql_title(sql_clean('text'))}) AS titled, md5(key) AS key,
       length(key) AS key_chars,
       md5(regexp_replace(regexp_replace(key, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM k""",
    "clean_text_keys_wide": f"SELECT doc_id, md5({sql_key('text')}) AS key FROM documents",
    "numeric_parse": f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber IN (3, 4) THEN NULL ELSE l_extendedprice END AS locale,
       CASE WHEN l_linenumber IN (1, 3, 4) THEN NULL ELSE l_extendedprice END AS plain,
       {sql_rounded('l_extendedprice / 18.1437::DOUBLE', 6)} AS kg FROM lineitem""",
    "month_parse": f"""
SELECT o_orderkey, {MONTH_CASE} AS mes_num,
       CASE WHEN o_orderstatus <> 'P' AND month(o_orderdate) <> 9 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS fecha
FROM orders""",
    "blank_names": f"""
SELECT lang, count(*) AS kept, sum(length(p))::BIGINT AS chars
FROM (SELECT lang, {sql_clean('line')} AS p FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) a) b
WHERE p <> '' GROUP BY 1""",
    "document_lines_header": f"""
WITH lines AS (SELECT source || '/' || doc_id AS file, unnest(string_split(text, chr(10))) AS value,
                      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
h AS (SELECT file, coalesce(min(line) FILTER ({CELLS} >= 3), 0) AS header_line FROM lines WHERE line < 20 GROUP BY 1),
t AS (SELECT h.file, header_line, value AS header, len(string_split(value, ',')) AS columnas FROM h JOIN lines l ON l.file = h.file AND line = header_line),
b AS (SELECT t.file, count(*) AS filas FROM t JOIN lines l ON l.file = t.file AND l.line > header_line AND trim(l.value) <> '' GROUP BY 1)
SELECT t.file, header_line, md5(header) AS header, CASE WHEN columnas >= 2 THEN coalesce(filas, 0) ELSE 0 END AS filas,
       CASE WHEN columnas >= 2 AND filas IS NOT NULL THEN columnas ELSE 0 END AS columnas
FROM t LEFT JOIN b USING (file)""",
    "source_names": """SELECT page_id, string_split(url, '/')[-1] AS name,
       NOT regexp_matches(lower(string_split(url, '/')[-1]), 'resumen|dashboard|grafico|chart|pivot|indice') AS valid FROM pages""",
    "group_medians": f"""SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag,
       {", ".join(f"{sql_rounded(f'quantile_cont(l_extendedprice, {q})', 4)} AS {n}" for n, q in (("q10", 0.1), ("q50", 0.5), ("q95", 0.95)))}
FROM lineitem GROUP BY 1, 2""",
}
