"""Text, curation, audit, set and merge queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold import constants as K
from wayfold.functions import columns as C
from wayfold.functions import scoring as S
from wayfold.functions.entities import WHITE, unescaped, unescaped_sql
from wayfold.functions.rounding import rounded_sql
from wayfold.operators import audits, curation, explanations, merges
from wayfold.operators.quantiles import quantiles
from wayfold.plans.registry import query
from wayfold.plans.retrieval import R6
from wayfold.sources import views as V

_NORM = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^0-9a-z가-힣]', '', 'g')"
_STRIP = lambda x: f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"
_CLEAN = lambda x: _STRIP(f"regexp_replace(regexp_replace({unescaped_sql('h')}, '<[^>]+>', '', 'g'), '{WHITE}+', ' ', 'g')").join(["(SELECT ", f" FROM (SELECT coalesce({x}, '') AS h))"])


def t(name):
    return lambda spark, sf: V.table(spark, sf, name)


@query("str01_normalise", f"SELECT p_partkey, {_NORM('p_name')} AS norm FROM part")
def _(spark, sf):
    return t("part")(spark, sf).select("p_partkey", C.normalised(F.col("p_name")).alias("norm"))


@query("str02_html_clean", f"SELECT page_id, md5({_CLEAN('html')}) AS digest FROM pages")
def _(spark, sf):
    return t("pages")(spark, sf).select("page_id", F.md5(C.clean_html(F.col("html")).cast("binary")).alias("digest"))


@query("str03_html_clean_v2", f"SELECT page_id, md5({_STRIP(unescaped_sql('h'))}) AS digest FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS h FROM pages)")
def _(spark, sf):
    return t("pages")(spark, sf).select("page_id", F.md5(C.clean_html_tags_first(F.col("html")).cast("binary")).alias("digest"))


@query("str02_references", f"SELECT poi_id, {unescaped_sql('h')} AS text FROM (SELECT poi_id, concat(name, ' &', CASE k % 7 WHEN 0 THEN 'middot;' WHEN 1 THEN '#x27;' WHEN 2 THEN 'notit' WHEN 3 THEN '#128;' WHEN 4 THEN 'eacute' WHEN 5 THEN 'amp;lt;' ELSE 'none' END, '&#', 8200 + k % 97, ';') AS h FROM v_poi)")
def _(spark, sf):
    """References of all kinds in names: named with and without semicolon, by number, forbidden, nested, none."""
    kinds = "CASE k % 7 WHEN 0 THEN 'middot;' WHEN 1 THEN '#x27;' WHEN 2 THEN 'notit' WHEN 3 THEN '#128;' WHEN 4 THEN 'eacute' WHEN 5 THEN 'amp;lt;' ELSE 'none' END"
    return V.poi(spark, sf).selectExpr("poi_id", f"concat(name, ' &', {kinds}, '&#', 8200 + k % 97, ';') AS h").select("poi_id", unescaped(F.col("h")).alias("text"))


@query("str08_specificity", f"SELECT p_partkey, CASE WHEN length(n) <= 1 THEN 0.2 WHEN length(n) = 2 THEN 0.4 WHEN length(n) = 3 THEN 0.6 WHEN length(n) = 4 THEN 0.8 ELSE 1 END::DOUBLE AS s FROM (SELECT p_partkey, substr({_NORM('p_name')}, 1, CAST(p_partkey % 7 AS INT)) AS n FROM part)")
def _(spark, sf):
    return t("part")(spark, sf).select("p_partkey", C.specificity(F.substring(C.normalised(F.col("p_name")), F.lit(1), (F.col("p_partkey") % 7).cast("int"))).alias("s"))


@query("str09_selection_score", "SELECT poi_id, round(ln(1 + least(coalesce(mentions, 0), p)) * 1.0, 6) AS score FROM v_poi, (SELECT quantile_cont(coalesce(mentions, 0), 0.95) AS p FROM v_poi)")
def _(spark, sf):
    rows = V.poi(spark, sf)
    cap = quantiles(rows, [], F.coalesce("mentions", F.lit(0)), {"p": 0.95})
    score = F.log1p(F.least(F.coalesce("mentions", F.lit(0)), F.col("p"))) * C.specificity(F.col("name"))
    return rows.crossJoin(F.broadcast(cap)).select("poi_id", R6(score, "score"))


@query("str10_last_token", "SELECT p_partkey, list_last(string_split_regex(trim(p_name), '\\s+')) AS token FROM part")
def _(spark, sf):
    return t("part")(spark, sf).select("p_partkey", F.element_at(F.split(F.trim("p_name"), r"\s+"), -1).alias("token"))


@query("str11_query_templates", "SELECT poi_id, unnest([concat(name, ' 후기'), concat(name, ' 리뷰'), concat(zone, ' ', name), concat(name, ' ', category)]) AS q FROM v_poi")
def _(spark, sf):
    one = [F.concat(F.col("name"), F.lit(" 후기")), F.concat(F.col("name"), F.lit(" 리뷰")), F.concat_ws(" ", "zone", "name"), F.concat_ws(" ", "name", "category")]
    return V.poi(spark, sf).select("poi_id", F.explode(F.array(*one)).alias("q"))


_TITLE = "concat('<b>', substr(text, 1, 60), '</b>')"


_BOUND = "concat('(^|[^0-9a-z가-힣])', array_to_string(string_split(" + _NORM("name") + r", ''), '[\s\p{P}_]*'), '($|[^0-9a-z가-힣])')"
_STANDS = lambda x: f"regexp_matches(lower({_CLEAN(x)}), {_BOUND})"
_CLOSE = lambda x: f"(contains({_NORM(x)}, {_NORM('place')}) OR contains({_NORM(x)}, 'the'))"


@query("str05_relevance", f"""SELECT doc_id, CASE WHEN {_NORM('name')} = '' OR NOT ({_STANDS('title')} OR {_STANDS('body')}) THEN 0 ELSE CASE WHEN {_STANDS('title')} THEN 3 ELSE 1 END + CASE WHEN {_CLOSE('title')} THEN 2 WHEN {_CLOSE('body')} THEN 1 ELSE 0 END END AS score
 FROM (SELECT doc_id, {_TITLE} AS title, text AS body, coalesce(string_split(trim(text), ' ')[2], '') AS name, coalesce(string_split(trim(text), ' ')[3], '') AS place FROM documents)""")
def _(spark, sf):
    rows = t("documents")(spark, sf).selectExpr("doc_id", f"{_TITLE} AS title", "text AS body", "coalesce(get(split(trim(text), ' '), 1), '') AS name", "array(coalesce(get(split(trim(text), ' '), 2), ''), 'the') AS places")
    return rows.select("doc_id", curation.relevance(F.col("name"), F.col("title"), F.col("body"), F.col("places")).alias("score"))


_PLAIN = lambda x: f"contains({_NORM(x)}, {_NORM('name')})"
_NEAR = lambda x: f"(contains({_NORM(x)}, {_NORM('place')}) OR contains({_NORM(x)}, 'the'))"


@query("str06_relevance_substring", f"""SELECT doc_id, CASE WHEN {_NORM('name')} = '' OR NOT ({_PLAIN('title')} OR {_PLAIN('body')}) THEN 0 ELSE CASE WHEN {_PLAIN('title')} THEN 3 ELSE 1 END + CASE WHEN {_NEAR('title')} THEN 2 WHEN {_NEAR('body')} THEN 1 ELSE 0 END END AS score
 FROM (SELECT doc_id, {_TITLE} AS title, text AS body, coalesce(string_split(trim(text), ' ')[2], '') AS name, coalesce(string_split(trim(text), ' ')[3], '') AS place FROM documents)""")
def _(spark, sf):
    word = lambda i: f"coalesce(get(split(trim(text), ' '), {i}), '')"
    rows = t("documents")(spark, sf).selectExpr("doc_id", f"{_TITLE} AS title", "text AS body", f"{word(1)} AS name", f"array({word(2)}, 'the') AS places")
    return rows.select("doc_id", curation.relevance(F.col("name"), F.col("title"), F.col("body"), F.col("places"), boundaries=False).alias("score"))


@query("str07_location_terms", "SELECT zone, count(*) AS pois, string_agg(DISTINCT area, ',' ORDER BY area) AS areas FROM v_poi GROUP BY zone")
def _(spark, sf):
    listed = F.array_sort(F.collect_set("area"))
    return V.poi(spark, sf).groupBy("zone").agg(F.count("*").alias("pois"), F.concat_ws(",", listed.cast("array<string>")).alias("areas"))


@query("str12_quote_containment", "SELECT b.item_id, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def _(spark, sf):
    documents = t("documents")(spark, sf).select("doc_id", "text")
    quotes = t("benchmark")(spark, sf).select("item_id", F.col("text").alias("quote"))
    return curation.containing(documents, quotes, "doc_id", "item_id").groupBy("item_id").agg(F.count("*").alias("docs"))


@query("str15_user_id", "SELECT c_custkey, concat('u_', substr(sha256(concat_ws('|', least(c_mktsegment, c_name), greatest(c_mktsegment, c_name))), 1, 6)) AS user_id, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 900000 + 100000 AS log_id FROM customer")
def _(spark, sf):
    key = F.sha2(F.concat_ws("|", F.array_sort(F.array("c_mktsegment", "c_name"))), 256)
    log = F.conv(F.substring(F.sha2("c_name", 256), 1, 8), 16, 10).cast("long") % 900000 + 100000
    return t("customer")(spark, sf).select("c_custkey", F.concat(F.lit("u_"), F.substring(key, 1, 6)).alias("user_id"), log.alias("log_id"))


@query("str15_cache_key", "SELECT area, sha256(string_agg(poi_id, '|' ORDER BY poi_id)) AS cache_key FROM v_poi GROUP BY area")
def _(spark, sf):
    return V.poi(spark, sf).groupBy("area").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("poi_id"))), 256).alias("cache_key"))


@query("str14_excerpt", "SELECT doc_id, md5(substr(coalesce(nullif(trim(text), ''), lang), 1, 300)) AS digest FROM documents")
def _(spark, sf):
    return t("documents")(spark, sf).select("doc_id", F.md5(F.substring(F.coalesce(F.nullif(F.trim("text"), F.lit("")), "lang"), 1, 300).cast("binary")).alias("digest"))


@query("str16_short_names", "SELECT poi_id, length(n) AS n FROM (SELECT poi_id, substr(category, 1, CAST(k % 9 AS INT)) AS n FROM v_poi) WHERE length(n) <= 2")
def _(spark, sf):
    short = F.substring("category", F.lit(1), (F.col("k") % 9).cast("int"))
    return V.poi(spark, sf).select("poi_id", F.length(short).cast("long").alias("n")).where("n <= 2")


@query("str20_code_fences", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events")
def _(spark, sf):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    parsed = F.from_json(F.regexp_replace(fenced, r"^```[a-z]*\s*|\s*```$", ""), "k long")
    return t("events")(spark, sf).select("event_id", parsed["k"].alias("k"))


@query("flt05_exclusion", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN upper(p_name) LIKE '%A%' AND p_type = 'STANDARD' THEN 'type' WHEN regexp_matches(lower(p_brand), 'brand#1') THEN 'brand' WHEN p_size > 40 THEN 'size' WHEN p_retailprice < 905 THEN 'price' END AS reason FROM part) GROUP BY reason")
def _(spark, sf):
    c = F.col
    rules = [("type", F.upper("p_name").contains("A") & (c("p_type") == "STANDARD")), ("brand", F.lower("p_brand").rlike("brand#1")), ("size", c("p_size") > 40), ("price", c("p_retailprice") < 905)]
    return t("part")(spark, sf).groupBy(curation.labelled_exclusion(rules).alias("reason")).agg(F.count("*").alias("n"))


@query("flt06_pattern", "SELECT p_partkey FROM part WHERE regexp_matches(lower(coalesce(p_name, '')), '(green|blue|1)')")
def _(spark, sf):
    return t("part")(spark, sf).where(F.coalesce("p_name", F.lit("")).rlike("(?iU)(green|blue|1)")).select("p_partkey")


@query("flt04_category_mapping", "SELECT CASE WHEN category = 'BUILDING' THEN '문화' WHEN category IN ('FURNITURE', 'HOUSEHOLD') THEN '쇼핑' WHEN starts_with(category, 'M') THEN '음식' END AS large, count(*) AS n FROM v_poi GROUP BY 1")
def _(spark, sf):
    c = F.col("category")
    large = F.when(c == "BUILDING", "문화").when(c.isin("FURNITURE", "HOUSEHOLD"), "쇼핑").when(c.startswith("M"), "음식")
    return V.poi(spark, sf).groupBy(large.alias("large")).agg(F.count("*").alias("n"))


@query("flt08_tiers", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN k % 10 < 3 THEN 1 WHEN area < 5 THEN 2 ELSE 3 END AS tier FROM v_poi) GROUP BY tier")
def _(spark, sf):
    rows = V.poi(spark, sf)
    chosen = rows.where("k % 10 < 3").select("poi_id", F.lit(1).alias("t1"))
    tier = F.coalesce("t1", F.when(F.col("area") < 5, 2), F.lit(3))
    return rows.join(chosen, "poi_id", "left").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("flt09_flt10_coercion", "SELECT p_partkey, lower(CASE WHEN p_partkey % 2 = 0 THEN 'TRUE' ELSE 'false' END) = 'true' AS flag, coalesce(TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE), 0) AS size FROM part")
def _(spark, sf):
    rows = t("part")(spark, sf)
    text = F.when(F.col("p_partkey") % 3 == 0, "-").otherwise(F.col("p_size").cast("string"))
    return rows.select("p_partkey", (F.lower(F.when(F.col("p_partkey") % 2 == 0, "TRUE").otherwise("false")) == "true").alias("flag"), F.coalesce(text.try_cast("double"), F.lit(0.0)).alias("size"))


@query("flt11_vocab", f"SELECT poi_id, len(list_filter([tag1, tag2, category], lambda x: x IN {K.PURPOSES})) AS n FROM v_poi")
def _(spark, sf):
    kept = F.array_intersect(F.array("tag1", "tag2", "category"), F.array(*map(F.lit, K.PURPOSES)))
    dup = F.when(F.col("tag1") == F.col("tag2"), 1).otherwise(0)
    return V.poi(spark, sf).select("poi_id", (F.size(kept) + dup).cast("long").alias("n"))


@query("flt12_pending", "SELECT poi_id FROM v_poi WHERE k % 10 < 3 AND quality IS NULL")
def _(spark, sf):
    return V.poi(spark, sf).where("k % 10 < 3 AND quality IS NULL").orderBy(F.desc_nulls_last("mentions"), "poi_id").select("poi_id")


@query("flt07_lookup_filter", "SELECT n_name, count(*) AS n FROM v_poi JOIN nation ON area = n_nationkey WHERE contains(n_name, 'A') GROUP BY n_name")
def _(spark, sf):
    names = F.broadcast(t("nation")(spark, sf).where(F.contains("n_name", F.lit("A"))))
    return V.poi(spark, sf).join(names, F.col("area") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


_TWICE = "(SELECT poi_id, name, lat, lng, category FROM v_poi UNION ALL SELECT concat(poi_id, 'x'), upper(concat(name, ' (', '!)')), CASE WHEN k % 3 = 0 THEN lat + 1e-5 ELSE lat + 1e-8 END, lng - 1e-8, category FROM v_poi)"


@query("win07_entity_dedup", f"SELECT min(poi_id) AS poi_id, count(*) AS n FROM {_TWICE} GROUP BY {_NORM('name')}, round(lng, 6), round(lat, 6), category")
def _(spark, sf):
    """Places and copies of them, of which two in three differ by signs and case of the name and less than a micro-degree alone."""
    rows = V.poi(spark, sf)
    copies = rows.selectExpr("concat(poi_id, 'x') AS poi_id", "upper(concat(name, ' (', '!)')) AS name", "CASE WHEN k % 3 = 0 THEN lat + 1e-5 ELSE lat + 1e-8 END AS lat", "lng - 1e-8 AS lng", "category")
    both = rows.select("poi_id", "name", "lat", "lng", "category").unionByName(copies)
    return curation.same_entities(both).select("poi_id", "n")


@query("win08_duplicate_report", "SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) - 1 AS removable FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return curation.duplicate_groups(t("orders")(spark, sf), ["o_custkey", "o_orderpriority"])


_QUOTA = "(SELECT area, category, n, base + CASE WHEN row_number() OVER (ORDER BY round(raw - base, 9) DESC, area, category) <= 800 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM (SELECT area, category, count(*) AS n, count(*) / sum(count(*)) OVER () * 800 AS raw FROM v_poi GROUP BY area, category)))"


@query("win09_quota", f"SELECT area, category, n, CAST(quota AS BIGINT) AS quota FROM {_QUOTA}")
def _(spark, sf):
    return curation.quotas(V.poi(spark, sf), ["area", "category"], K.QUOTA_TOTAL)


@query("win10_group_topk", f"SELECT poi_id, place FROM (SELECT *, row_number() OVER (PARTITION BY p.area, p.category ORDER BY coalesce(mentions, 0) DESC, name) AS place FROM v_poi p JOIN {_QUOTA} q ON p.area = q.area AND p.category = q.category) WHERE place <= quota")
def _(spark, sf):
    rows = V.poi(spark, sf)
    quota = curation.quotas(rows, ["area", "category"], K.QUOTA_TOTAL)
    order = [F.coalesce("mentions", F.lit(0)).desc(), F.col("name")]
    return curation.top_by_quota(rows, quota, ["area", "category"], order).select("poi_id", F.col("place").cast("long").alias("place"))


@query("win06_argmin", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return curation.first_per(t("orders")(spark, sf), ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("win14_round_robin", "SELECT user_id, item, place FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM (SELECT user_id, item, min((r, lane)) AS pos FROM (SELECT user_id, event_id % 40 AS item, event_type AS lane, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) GROUP BY user_id, item)) WHERE place <= 15")
def _(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    rows = t("events")(spark, sf).select("user_id", (F.col("event_id") % 40).alias("item"), F.col("event_type").alias("lane"), F.row_number().over(w).alias("r"))
    return curation.round_robin(rows, "user_id", "lane", "r", "item", 15).withColumn("place", F.col("place").cast("long"))


@query("win15_priority_merge", "SELECT conv_id, item, place FROM (SELECT conv_id, item, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM (SELECT conv_id, item, min((src, turn)) AS pos FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS src, substr(text, 1, 3) AS item FROM conversations) GROUP BY conv_id, item)) WHERE place <= 15")
def _(spark, sf):
    rows = t("conversations")(spark, sf).select("conv_id", F.when(F.col("role") == "user", 0).otherwise(1).alias("src"), "turn", F.substring("text", 1, 3).alias("item"))
    return curation.round_robin(rows, "conv_id", "turn", "src", "item", 15).withColumn("place", F.col("place").cast("long"))


@query("win16_top50", "SELECT poi_id, mentions FROM v_poi ORDER BY mentions DESC NULLS LAST, poi_id LIMIT 50")
def _(spark, sf):
    return V.poi(spark, sf).orderBy(F.desc_nulls_last("mentions"), "poi_id").limit(50).select("poi_id", "mentions")


@query("win17_stratified", "SELECT zone, poi_id FROM (SELECT zone, poi_id, row_number() OVER (PARTITION BY zone ORDER BY sha256(concat('seed', poi_id)), poi_id) AS r FROM v_poi) WHERE r <= 20")
def _(spark, sf):
    return curation.stratified(V.poi(spark, sf), "zone", "poi_id", 20, "seed").select("zone", "poi_id")


@query("agg05_global_stats", "SELECT round(avg(sentiment), 6) AS mean, round(quantile_cont(coalesce(mentions, 0), 0.95), 6) AS p95 FROM v_poi")
def _(spark, sf):
    rows = V.poi(spark, sf)
    p95 = quantiles(rows, [], F.coalesce("mentions", F.lit(0)), {"p95": 0.95}).select(R6(F.col("p95"), "p95"))
    return rows.agg(R6(F.avg("sentiment"), "mean")).crossJoin(p95)


_COUNTED = "(SELECT p.*, coalesce(c, 0) AS clean FROM v_poi p LEFT JOIN (SELECT poi_id, count(*) FILTER (WHERE NOT sponsored) AS c FROM v_review GROUP BY poi_id) USING (poi_id))"


def clean_counts(spark, sf):
    counts = V.reviews(spark, sf).groupBy("poi_id").agg(F.count_if(~F.col("sponsored")).alias("c"))
    return V.poi(spark, sf).join(counts, "poi_id", "left").withColumn("clean", F.coalesce("c", F.lit(0))).drop("c")


@query("jon09_filtered_count", f"SELECT poi_id, clean FROM {_COUNTED}")
def _(spark, sf):
    return clean_counts(spark, sf).select("poi_id", "clean")


@query("agg06_quality", f"SELECT poi_id, round(least(greatest((8 * m + coalesce(sentiment, m) * clean) / (8 + clean) * ln(1 + least(coalesce(mentions, 0), p)) / ln(1 + p), 0), 1), 6) AS quality FROM {_COUNTED}, (SELECT avg(sentiment) AS m, quantile_cont(coalesce(mentions, 0), 0.95) AS p FROM v_poi)")
def _(spark, sf):
    rows = clean_counts(spark, sf).drop("quality")
    return curation.quality(rows).select("poi_id", R6(F.col("quality"), "quality"))


_FIELDS = {
    "outdoor_exposure": "exposure", "group_capacity": "capacity", "noise_level": "CASE k % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'quiet' END",
    "purpose_tags": "tag1", "atmosphere_tags": "CASE WHEN k % 3 = 0 THEN NULL ELSE 'cosy' END", "price_band": "price", "wait_intensity": "CASE WHEN k % 6 = 0 THEN '' ELSE 'short' END",
    "business_hours_hint": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '{\"open\":null,\"close\":\" \"}' ELSE '{\"open\":\"9:00\",\"close\":null}' END", "sentiment_score": "sentiment",
}
_LACKS = " + ".join([*(f"(({_FIELDS[f]}) IS NULL)::INT" for f in ("outdoor_exposure", "group_capacity", "purpose_tags", "atmosphere_tags", "price_band", "sentiment_score")), "(k % 4 < 2)::INT", "(k % 6 = 0)::INT", "(k % 5 < 3)::INT"])


@query("sco16_confidence", f"SELECT poi_id, missing, clean, greatest({rounded_sql('least(clean / 8.0::DOUBLE, 1) - missing * 0.08::DOUBLE', 3)}, 0) AS confidence FROM (SELECT p.poi_id, {_LACKS} AS missing, coalesce(c, 0) AS clean FROM v_poi p LEFT JOIN (SELECT poi_id, count(*) FILTER (WHERE NOT sponsored AND relevant) AS c FROM v_review GROUP BY poi_id) r ON p.poi_id = r.poi_id)")
def _(spark, sf):
    """Nine fields, of which blank texts, empty lists and objects without values count as missing, and relevant clean reviews."""
    counts = V.reviews(spark, sf).groupBy("poi_id").agg(F.count_if(~F.col("sponsored") & F.col("relevant")).alias("c"))
    fields = {n: F.array_compact(F.array(F.expr(e))) if S.ATTRIBUTES[n] == "list" else F.expr(e) for n, e in _FIELDS.items()}
    missing = sum((S.without_value(f, S.ATTRIBUTES[n]).cast("int") for n, f in fields.items()), F.lit(0))
    rows = V.poi(spark, sf).select("poi_id", missing.alias("missing")).join(counts, "poi_id", "left").withColumn("clean", F.coalesce("c", F.lit(0)))
    return rows.select("poi_id", "missing", "clean", S.attr_confidence(F.col("clean"), F.col("missing")).alias("confidence"))


@query("jsn10_attr_validation", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (doc_id % 2 = 0)::INT + 1 END AS clean, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS sentiment FROM documents")
def _(spark, sf):
    rows = t("documents")(spark, sf).selectExpr("doc_id", f"array('{K.PURPOSES[0]}', 'zzz') AS tags", "array(true, doc_id % 2 = 0, false) AS relevant", "CASE WHEN doc_id % 4 = 0 THEN array(false) ELSE array(false, false, true) END AS sponsored", "array(0, 5, 1, 0) AS chosen", "0.5D AS sentiment")
    return curation.valid_attributes(rows, K.PURPOSES).select("doc_id", "clean", F.col("valid_sentiment").alias("sentiment"))


@query("agg07_readiness", "SELECT name, n, total, round(n / total, 6) AS rate, CASE WHEN n = 0 AND name = 'zone' THEN 'FAIL' WHEN n / total < 0.5 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT unnest(['zone', 'tags', 'vector', 'late']) AS name, unnest([count(zone), count(tag1), count(vec_id), count(*) FILTER (WHERE closes = '2:00')]) AS n, count(*) AS total FROM v_poi)")
def _(spark, sf):
    c = F.col
    checks = {"zone": c("zone").isNotNull(), "tags": c("tag1").isNotNull(), "vector": c("vec_id").isNotNull(), "late": c("closes") == "2:00"}
    return audits.observed(V.poi(spark, sf), checks, ("zone",)).withColumn("rate", F.round("rate", 6))


@query("agg08_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _(spark, sf):
    return t("events")(spark, sf).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("agg09_percentile_cont", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value = 0) AS zeros FROM events GROUP BY event_type")
def _(spark, sf):
    rows = t("events")(spark, sf)
    medians = quantiles(rows, ["event_type"], F.col("value"), {"median": 0.5}).withColumn("median", F.round("median", 6))
    return rows.groupBy("event_type").agg(R6(F.avg("value"), "mean"), F.count_if(F.col("value") == 0).alias("zeros")).join(medians, "event_type")


@query("agg10_summary", "SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return t("lineitem")(spark, sf).groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), R6(F.avg("l_quantity"), "mean"))


@query("agg11_agg12_value_counts", "SELECT tag1, count(*) AS n FROM v_poi GROUP BY tag1")
def _(spark, sf):
    return V.poi(spark, sf).groupBy("tag1").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag1")


@query("agg13_crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    return audits.crosstab(t("orders")(spark, sf), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("agg14_mapped_rate", "SELECT area, count(*) AS total, count(tag1) AS mapped, round(count(tag1) / count(*), 4) AS rate FROM v_poi GROUP BY area")
def _(spark, sf):
    return V.poi(spark, sf).groupBy("area").agg(F.count("*").alias("total"), F.count("tag1").alias("mapped"), F.round(F.count("tag1") / F.count("*"), 4).alias("rate"))


@query("agg15_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.9), 4) AS q90, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    rows, at = t("orders")(spark, sf), {"q25": 0.25, "q50": 0.5, "q90": 0.9}
    found = quantiles(rows, ["o_orderstatus"], F.col("o_totalprice"), at).select("o_orderstatus", *(F.round(n, 4).alias(n) for n in at))
    return found.join(rows.groupBy("o_orderstatus").agg(F.round(F.stddev_samp("o_totalprice"), 4).alias("sd")), "o_orderstatus")


@query("agg16_histogram", "SELECT CASE WHEN p_retailprice <= 950 THEN 0 WHEN p_retailprice <= 1000 THEN 1 WHEN p_retailprice <= 1200 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return audits.histogram(t("part")(spark, sf), F.col("p_retailprice"), [950.0, 1000.0, 1200.0])


@query("agg17_threshold_sweep", "SELECT b::DOUBLE AS bound, count(*) FILTER (WHERE n >= b) AS n, count(*) AS total FROM (SELECT count(*) AS n FROM v_review GROUP BY poi_id), (SELECT unnest([1, 3, 5, 8, 10, 15]) AS b) GROUP BY b")
def _(spark, sf):
    counts = V.reviews(spark, sf).groupBy("poi_id").agg(F.count("*").alias("reviews"))
    return audits.sweep(counts, F.col("reviews"), [1, 3, 5, 8, 10, 15], True)


@query("agg24_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def _(spark, sf):
    return audits.nearest_rank(t("events")(spark, sf), ["event_type"], "value", [0.5, 0.95, 0.99])


_SPREAD = "(SELECT term, avg(s) AS sigma FROM (SELECT area, term, stddev_pop(v) AS s FROM (SELECT area, unnest(['quality', 'context_fit']) AS term, unnest([quality, exposure]) AS v FROM v_poi) WHERE v IS NOT NULL GROUP BY area, term HAVING count(*) >= 2) GROUP BY term)"


def spreads(spark, sf):
    return audits.spread(V.poi(spark, sf).withColumnRenamed("exposure", "context_fit"), "area", ["quality", "context_fit"])


@query("agg25_term_spread", f"SELECT term, round(sigma, 6) AS sigma, sigma > 1e-6 AS alive FROM {_SPREAD}")
def _(spark, sf):
    return spreads(spark, sf).withColumn("sigma", F.round("sigma", 6))


@query("agg26_contribution", f"SELECT term, round(w * sigma / sum(w * sigma) OVER (), 6) AS share, round(w / sum(w) OVER (), 6) AS design FROM (SELECT *, (CASE term WHEN 'quality' THEN 0.09 ELSE 0.13 END)::DOUBLE AS w FROM {_SPREAD})")
def _(spark, sf):
    out = audits.contribution(spreads(spark, sf), {k: K.WEIGHTS[k] for k in ("quality", "context_fit")})
    return out.select("term", R6(F.col("share"), "share"), R6(F.col("design"), "design"))


@query("agg27_live_weight", "SELECT round(sum(w) FILTER (WHERE r >= 0.5), 6) AS live, count(*) FILTER (WHERE r > 0 AND r < 0.5) AS thin FROM (SELECT unnest([0.22, 0.09, 0.13])::DOUBLE AS w, unnest([count(tag1) / count(*), count(quality) / count(*), count(*) FILTER (WHERE closes = '2:00') / count(*)]) AS r FROM v_poi)")
def _(spark, sf):
    c = F.col
    rates = audits.observed(V.poi(spark, sf), {"a": c("tag1").isNotNull(), "b": c("quality").isNotNull(), "c": c("closes") == "2:00"})
    w = C.lookup(c("name"), {"a": 0.22, "b": 0.09, "c": 0.13})
    return rates.agg(R6(F.sum(F.when(c("rate") >= 0.5, w)), "live"), F.count_if((c("rate") > 0) & (c("rate") < 0.5)).alias("thin"))


_V = {"base": (0.09, 0.13), "quality_up": (0.2, 0.13), "context_up": (0.09, 0.4)}
_RANK = "(SELECT area, poi_id, variant, row_number() OVER (PARTITION BY area, variant ORDER BY s DESC NULLS LAST, poi_id) AS r FROM (SELECT area, poi_id, unnest(['base', 'quality_up', 'context_up']) AS variant, unnest([" + ", ".join(f"round((coalesce(quality * {a}, 0) + coalesce(exposure * {b}, 0)) / nullif((CASE WHEN quality IS NULL THEN 0 ELSE {a} END) + (CASE WHEN exposure IS NULL THEN 0 ELSE {b} END), 0), 9)" for a, b in _V.values()) + "]) AS s FROM v_poi))"


@query("sco17_weight_sensitivity", f"SELECT v.variant, round(avg(kept), 6) AS kept, round(avg(changed), 6) AS changed FROM (SELECT b.area, v.variant, count(*) FILTER (WHERE v.r <= 5 AND b.r <= 5) / count(*) FILTER (WHERE b.r <= 5) AS kept, max(CASE WHEN b.r = 1 AND v.r <> 1 THEN 1 ELSE 0 END) AS changed FROM {_RANK} b JOIN {_RANK} v ON b.area = v.area AND b.poi_id = v.poi_id WHERE b.variant = 'base' AND v.variant <> 'base' GROUP BY b.area, v.variant) v GROUP BY v.variant")
def _(spark, sf):
    rows = V.poi(spark, sf).select(F.col("area").alias("log_id"), "poi_id", "quality", F.col("exposure").alias("context_fit"))
    named = {n: dict(zip(("quality", "context_fit"), w)) for n, w in _V.items()}
    out = audits.sensitivity(rows, {k: v for k, v in named.items() if k != "base"}, named["base"])
    return out.select("variant", R6(F.col("kept"), "kept"), R6(F.col("changed"), "changed"))


@query("jsn12_picked_passed", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS picked, count(*) FILTER (WHERE event_type <> 'purchase') AS passed FROM events GROUP BY user_id")
def _(spark, sf):
    picked = F.col("event_type") == "purchase"
    return t("events")(spark, sf).groupBy("user_id").agg(F.count_if(picked).alias("picked"), F.count_if(~picked).alias("passed"))


@query("jsn13_feedback_report", "SELECT count(*) AS n, round(avg(CASE WHEN r <= 2 THEN 1 ELSE 0 END), 6) AS top2, CASE WHEN count(*) < 200 THEN 'few' WHEN avg(CASE WHEN r <= 2 THEN 1 ELSE 0 END) < 0.7 THEN 'ok' ELSE 'biased' END AS verdict FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE event_type = 'click'")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    picks = t("events")(spark, sf).withColumn("r", F.row_number().over(w)).where("event_type = 'click'")
    top2 = F.avg(F.when(F.col("r") <= 2, 1).otherwise(0))
    return picks.agg(F.count("*").alias("n"), R6(top2, "top2"), F.when(F.count("*") < 200, "few").when(top2 < 0.7, "ok").otherwise("biased").alias("verdict"))


@query("jsn11_verify_results", "SELECT user_id, arg_min(event_type, event_id) AS reason FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND event_type <> '' GROUP BY user_id")
def _(spark, sf):
    allowed = t("customer")(spark, sf).where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"))
    rows = t("events")(spark, sf).join(allowed, "user_id", "left_semi").where("event_type <> ''")
    return curation.first_per(rows, ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("reason"))


@query("qcx01_qcx02_checks", "SELECT name, n FROM (SELECT unnest(['no quality', 'no place', 'bad category', 'bad price']) AS name, unnest([count(*) FILTER (WHERE quality IS NULL), count(*) FILTER (WHERE lat IS NULL OR lng IS NULL), count(*) FILTER (WHERE category NOT IN ('BUILDING', 'MACHINERY')), count(*) FILTER (WHERE price NOT BETWEEN 1 AND 3)]) AS n FROM v_poi)")
def _(spark, sf):
    c = F.col
    checks = {"no quality": c("quality").isNull(), "no place": c("lat").isNull() | c("lng").isNull(), "bad category": ~c("category").isin("BUILDING", "MACHINERY"), "bad price": ~c("price").between(1, 3)}
    return audits.observed(V.poi(spark, sf), checks).select("name", "n")


@query("qcx04_label_mismatch", "SELECT poi_id FROM v_poi WHERE tag1 IS DISTINCT FROM tag2")
def _(spark, sf):
    return V.poi(spark, sf).where(~F.col("tag1").eqNullSafe(F.col("tag2"))).select("poi_id")


@query("qcx05_residuals", "SELECT poi_id FROM v_poi WHERE coalesce(quality, 0) <> 0 OR coalesce(sentiment, 0) <> 0 OR coalesce(mentions, 0) <> 0")
def _(spark, sf):
    some = F.lit(False)
    for c in ("quality", "sentiment", "mentions"):
        some = some | (F.coalesce(c, F.lit(0)) != 0)
    return V.poi(spark, sf).where(some).select("poi_id")


@query("qcx06_group_counts", "SELECT zone, tag1, count(*) AS n FROM v_poi GROUP BY zone, tag1")
def _(spark, sf):
    return V.poi(spark, sf).groupBy("zone", "tag1").agg(F.count("*").alias("n")).orderBy("zone", F.desc("n"))


@query("qcx07_first_names", "SELECT area, name FROM (SELECT area, name, row_number() OVER (PARTITION BY area ORDER BY name) AS r FROM v_poi) WHERE r <= 10")
def _(spark, sf):
    w = Window.partitionBy("area").orderBy("name")
    return V.poi(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 10").select("area", "name")


@query("qcx08_keyword_mask", "SELECT page_id FROM pages WHERE regexp_matches(html, 'table|nav|script')")
def _(spark, sf):
    return t("pages")(spark, sf).where(F.col("html").rlike("table|nav|script")).select("page_id")


@query("qcx09_axis_audit", "SELECT b AS band FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS b) WHERE b NOT IN (SELECT band FROM v_sales)")
def _(spark, sf):
    seen = V.sales(spark, sf).select("band").distinct()
    return spark.range(9).select(F.col("id").cast("int").alias("band")).join(seen, "band", "left_anti")


@query("qcx10_observation_rate", "SELECT name, round(n / total, 6) AS rate FROM (SELECT unnest(['capacity', 'price', 'exposure']) AS name, unnest([count(capacity), count(price), count(exposure)]) AS n, count(*) AS total FROM v_poi)")
def _(spark, sf):
    return audits.observed(V.poi(spark, sf), {c: F.col(c).isNotNull() for c in ("capacity", "price", "exposure")}).select("name", R6(F.col("rate"), "rate"))


@query("qcx12_dashboard", "SELECT count(*) AS pois, count(DISTINCT area) AS areas, count(tag1) AS tagged, count(vec_id) AS vectors, count(*) FILTER (WHERE confidence >= 0.3) AS usable FROM v_poi")
def _(spark, sf):
    return V.poi(spark, sf).agg(F.count("*").alias("pois"), F.countDistinct("area").alias("areas"), F.count("tag1").alias("tagged"), F.count("vec_id").alias("vectors"), F.count_if(F.col("confidence") >= 0.3).alias("usable"))


@query("qcx13_confidence_gate", "SELECT round(avg(CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END), 6) AS share, round(avg(confidence), 6) AS mean, avg(CASE WHEN confidence >= 0.5 THEN 1 ELSE 0 END) >= 0.7 AS passed FROM v_poi")
def _(spark, sf):
    share = F.avg(F.when(F.col("confidence") >= 0.5, 1).otherwise(0))
    return V.poi(spark, sf).agg(R6(share, "share"), R6(F.avg("confidence"), "mean"), (share >= 0.7).alias("passed"))


@query("qcx14_reconcile", "SELECT a.o_orderkey, a.o_totalprice <> b.o_totalprice AS differs FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 0) b USING (o_orderkey)")
def _(spark, sf):
    rows = t("orders")(spark, sf)
    other = rows.where("o_orderkey % 4 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("_p"))
    return rows.where("o_orderkey % 3 <> 0").join(other, "o_orderkey").select("o_orderkey", (F.col("o_totalprice") != F.col("_p")).alias("differs"))


@query("set01_union", "SELECT source, count(*) AS n FROM (SELECT 'store' AS source, poi_id FROM v_poi WHERE k % 2 = 0 UNION ALL SELECT 'tour', poi_id FROM v_poi WHERE k % 3 = 0) GROUP BY source")
def _(spark, sf):
    p = V.poi(spark, sf)
    both = p.where("k % 2 = 0").select(F.lit("store").alias("source"), "poi_id").unionByName(p.where("k % 3 = 0").select(F.lit("tour").alias("source"), "poi_id"))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("set02_except", "(SELECT 'missing' AS side, o_custkey AS id FROM (SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) UNION ALL SELECT 'extra', user_id FROM (SELECT user_id FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(spark, sf):
    ids = lambda n, c: t(n)(spark, sf).select(F.col(c).alias("id"))
    missing = ids("customer", "c_custkey").subtract(ids("orders", "o_custkey")).select(F.lit("missing").alias("side"), "id")
    return missing.unionByName(ids("events", "user_id").subtract(ids("customer", "c_custkey").where("id % 2 = 0")).select(F.lit("extra").alias("side"), "id"))


@query("set03_intersect", "SELECT area FROM (SELECT c_nationkey AS area FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def _(spark, sf):
    return t("customer")(spark, sf).select(F.col("c_nationkey").alias("area")).intersect(t("supplier")(spark, sf).select("s_nationkey"))


@query("set04_key_union", "SELECT k FROM (SELECT o_custkey AS k FROM orders UNION SELECT user_id FROM events)")
def _(spark, sf):
    return t("orders")(spark, sf).select(F.col("o_custkey").alias("k")).union(t("events")(spark, sf).select("user_id")).distinct().orderBy("k")


@query("jon02_jon03_left_fill", "SELECT p.poi_id, coalesce(p.tag1, z.zone_tag) AS tag FROM v_poi p LEFT JOIN (SELECT zone, min(tag1) AS zone_tag FROM v_poi GROUP BY zone) z USING (zone)")
def _(spark, sf):
    rows = V.poi(spark, sf)
    fill = rows.groupBy("zone").agg(F.min("tag1").alias("zone_tag"))
    return rows.join(fill, "zone", "left").select("poi_id", F.coalesce("tag1", "zone_tag").alias("tag"))


@query("jon10_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, sf):
    return t("customer")(spark, sf).join(t("orders")(spark, sf).where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jon11_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, sf):
    hits = t("lineitem")(spark, sf).where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return t("part")(spark, sf).join(hits, "p_partkey", "left_semi").select("p_partkey")


_T, _SRC = "(SELECT c_custkey AS id, c_name AS a, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0)", "(SELECT c_custkey AS id, upper(c_mktsegment) AS a, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal * 2 END AS b FROM customer WHERE c_custkey % 2 = 0)"


def halves(spark, sf):
    c = t("customer")(spark, sf)
    target = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_name AS a", "c_acctbal AS b")
    return target, c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "upper(c_mktsegment) AS a", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal * 2 END AS b")


@query("snk04_upsert", f"SELECT id, CASE WHEN s.id IS NOT NULL THEN s.a ELSE t.a END AS a, CASE WHEN s.id IS NOT NULL THEN s.b ELSE t.b END AS b FROM {_T} t FULL JOIN {_SRC} s USING (id)")
def _(spark, sf):
    return merges.upsert(*halves(spark, sf), ["id"])


@query("snk05_partial_upsert", f"SELECT id, t.a, CASE WHEN s.id IS NOT NULL THEN s.b ELSE t.b END AS b FROM {_T} t FULL JOIN {_SRC} s USING (id)")
def _(spark, sf):
    return merges.upsert(*halves(spark, sf), ["id"], ["b"])


@query("snk06_coalesce_upsert", f"SELECT id, coalesce(s.a, t.a) AS a, coalesce(s.b, t.b) AS b FROM {_T} t FULL JOIN {_SRC} s USING (id)")
def _(spark, sf):
    return merges.upsert(*halves(spark, sf), ["id"], keep_old=True)


@query("snk07_range_replace", f"SELECT * FROM {_T} WHERE id NOT IN (SELECT id FROM {_SRC}) UNION ALL SELECT * FROM {_SRC}")
def _(spark, sf):
    return merges.replace_scope(*halves(spark, sf), ["id"])


@query("snk08_snapshot_merge", "SELECT code, slot, max(event_id) AS event_id FROM (SELECT code, event_id, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS slot FROM v_snapshot) GROUP BY code, slot")
def _(spark, sf):
    rows = V.snapshots(spark, sf).select("code", "event_id", F.date_format(F.window("ts", "15 minutes")["start"], "yyyy-MM-dd HH:mm").alias("slot"))
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return merges.last_wins(old.unionByName(new), ["code", "slot"], ["event_id"])


@query("snk09_guarded_insert", f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_SRC} WHERE id NOT IN (SELECT id FROM {_T}) AND id IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    target, source = halves(spark, sf)
    return merges.guarded_insert(target, source, ["id"], t("orders")(spark, sf).select(F.col("o_custkey").alias("id")).distinct(), "id")


@query("snk11_conditional_null", "SELECT poi_id, CASE WHEN confidence < 0.3 THEN NULL ELSE quality END AS quality, CASE WHEN confidence < 0.3 THEN 3 WHEN k % 10 < 3 THEN 1 ELSE 2 END AS tier FROM v_poi")
def _(spark, sf):
    low = F.col("confidence") < 0.3
    return V.poi(spark, sf).select("poi_id", F.when(~low, F.col("quality")).alias("quality"), F.when(low, 3).when(F.col("k") % 10 < 3, 1).otherwise(2).alias("tier"))


@query("snk12_unknown_user", "SELECT event_id, c_custkey AS user_id FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON user_id = c_custkey")
def _(spark, sf):
    users = t("customer")(spark, sf).where("c_custkey % 2 = 0").select("c_custkey")
    return t("events")(spark, sf).join(users, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("c_custkey").alias("user_id"))


@query("snk13_click_union", "SELECT c_custkey AS user_id, array_to_string(list_distinct_in_order, ',') AS clicked, CASE WHEN c_custkey % 3 = 0 THEN coalesce(picked, -1) ELSE picked END AS picked FROM (SELECT c_custkey, picked, (SELECT list(x ORDER BY o) FROM (SELECT x, min(o) AS o FROM (SELECT unnest(vals) AS x, unnest(range(len(vals))) AS o) GROUP BY x)) AS list_distinct_in_order FROM (SELECT c_custkey, e.picked, list_concat([c_mktsegment, 'view'], coalesce(e.vals, [])) AS vals FROM customer LEFT JOIN (SELECT user_id, list(event_type ORDER BY ts, event_id) AS vals, arg_max(event_id, (ts, event_id)) AS picked FROM events GROUP BY user_id) e ON c_custkey = e.user_id))")
def _(spark, sf):
    """Clicks in order of their first appearance; the picked item is set where new, and kept where it is not."""
    old = t("customer")(spark, sf).select(F.col("c_custkey").alias("user_id"), F.array("c_mktsegment", F.lit("view")).alias("clicked"), F.when(F.col("c_custkey") % 3 == 0, F.lit(-1)).cast("long").alias("picked"))
    new = t("events")(spark, sf).select("user_id", F.col("event_type").alias("clicked"), F.col("event_id").alias("picked"), F.struct("ts", "event_id").alias("at"))
    return merges.appended(old, new, "user_id", "clicked", "at", ["picked"]).select("user_id", F.concat_ws(",", "clicked").alias("clicked"), "picked")


@query("snk14_cache_hits", "SELECT props AS cache_key, 5 + count(*) AS hits, concat(arg_min(event_type, event_id), ':', min(event_id)) AS payload FROM events GROUP BY props")
def _(spark, sf):
    """Each request counts a hit on the cache's row of its key, and the payload comes back."""
    events = t("events")(spark, sf)
    first = F.min(F.struct("event_id", "event_type")).alias("f")
    cache = events.groupBy(F.col("props").alias("cache_key")).agg(first).select("cache_key", F.concat("f.event_type", F.lit(":"), "f.event_id").alias("payload"), F.lit(5).alias("hit_count"))
    return merges.hit(cache, events.select(F.col("props").alias("cache_key")), "cache_key", "hit_count").select("cache_key", F.col("hit_count").alias("hits"), "payload")


@query("exp01_cascade", """WITH allowed AS (SELECT c_custkey AS user_id, concat('p', (c_custkey * 7 + i) % 100) AS poi_id FROM customer, range(4) r(i)),
 items AS (SELECT user_id, concat('p', event_id % 100) AS poi_id, event_id AS n, event_type, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE concat(event_type, ' ', event_id) END AS reason FROM events),
 good AS (SELECT i.user_id, i.poi_id, event_type = 'click' AS cached, arg_min(reason, n) AS reason FROM items i SEMI JOIN allowed a ON i.user_id = a.user_id AND i.poi_id = a.poi_id WHERE trim(reason) <> '' AND event_type IN ('click', 'view') GROUP BY ALL)
 SELECT a.user_id, a.poi_id, coalesce(CASE WHEN m.c THEN c.reason WHEN m.v THEN v.reason END, 'A good match nearby') AS reason, CASE WHEN m.c THEN 'cache' WHEN m.v THEN 'llm' ELSE 'template' END AS mode
 FROM allowed a LEFT JOIN (SELECT user_id, bool_or(cached) AS c, bool_or(NOT cached) AS v FROM good GROUP BY user_id) m ON a.user_id = m.user_id
 LEFT JOIN good c ON c.cached AND c.user_id = a.user_id AND c.poi_id = a.poi_id LEFT JOIN good v ON NOT v.cached AND v.user_id = a.user_id AND v.poi_id = a.poi_id""")
def _(spark, sf):
    """Four places of each customer, explained by clicks as the cache and views as the model, some with blank reasons."""
    allowed = t("customer")(spark, sf).select(F.col("c_custkey").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    allowed = allowed.selectExpr("user_id", "concat('p', (user_id * 7 + i) % 100) AS poi_id")
    items = t("events")(spark, sf).selectExpr("user_id", "concat('p', event_id % 100) AS poi_id", "event_id AS at", "event_type", "CASE WHEN event_id % 5 = 0 THEN ' ' ELSE concat(event_type, ' ', event_id) END AS reason")
    return explanations.cascade(allowed, items.where("event_type = 'click'"), items.where("event_type = 'view'"), "user_id", "A good match nearby")


@query("snk16_id_coercion", "SELECT event_id, NULLIF(regexp_replace(trim(raw), '\\.0$', ''), '') AS id FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat(event_id, '.0') WHEN 1 THEN ' ' ELSE concat('tour_', event_id) END AS raw FROM events)")
def _(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id"), F.lit(".0"))).when(F.col("event_id") % 3 == 1, " ").otherwise(F.concat(F.lit("TOUR_"), F.col("event_id")))
    return t("events")(spark, sf).select("event_id", F.nullif(F.regexp_replace(F.regexp_replace(F.trim(raw), r"\.0$", ""), "^TOUR_", "tour_"), F.lit("")).alias("id"))


@query("src04_last_wins", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return merges.last_wins(t("conversations")(spark, sf), ["conv_id"], ["turn"]).select("conv_id", "text")


@query("src13_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return merges.resume(t("documents")(spark, sf), t("labels")(spark, sf), ["doc_id"]).select("doc_id")


@query("src08_table_scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
def _(spark, sf):
    return t("orders")(spark, sf).where("o_orderstatus = 'F' AND o_totalprice > 400000").select("o_orderkey")


_COLUMNS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query("src14_catalog", " UNION ALL ".join(f"SELECT '{c}' AS col, '{k}' AS type, count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS kinds FROM events" for c, k in _COLUMNS.items()))
def _(spark, sf):
    """The columns of a table as its schema has them, with their rows, nulls and distinct values."""
    return audits.catalog(t("events")(spark, sf))


