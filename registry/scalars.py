"""Scalar functions over lines, sheets, documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import money, scope, text, vectors
from partloom.operators import corrections, lookup, mapping, sessions
from partloom.sources.sheets import row_maps
from partloom.sources.side_tables import manufacturer_names
from partloom.sources.sinks import default_description
from registry import sqlx
from registry.core import num, query
from registry.domain import LAYOUTS


@query(
    "C1_clean_money",
    f"""SELECT item_id, CAST({sqlx.money('raw_std_cost')} AS DOUBLE) AS std_cost,
    CAST({sqlx.money('raw_last_purchase_price')} AS DOUBLE) AS paid, CAST({sqlx.money('raw_last_po')} AS DOUBLE) AS po FROM raw_all""",
    "raw_all",
)
def clean_money(d):
    cost, paid, po = (money.clean_money(F.col(c)) for c in ("raw_std_cost", "raw_last_purchase_price", "raw_last_po"))
    return d.raw.select("item_id", num(cost).alias("std_cost"), num(paid).alias("paid"), num(po).alias("po"))


@query("C2_clean_quantity", f"SELECT item_id, {sqlx.quantity('raw_eau')} AS eau FROM raw_all", "raw_all")
def clean_quantity(d):
    return d.raw.select("item_id", money.clean_quantity(F.col("raw_eau")).alias("eau"))


@query(
    "C3_volume_multiplier",
    "SELECT item_id, CASE WHEN f.volume_multiplier > 1 THEN eau * f.volume_multiplier ELSE eau END AS eau "
    "FROM lines JOIN files f USING (file_id)",
    "lines",
    "files",
)
def volume_multiplier(d):
    files = d.files.select("file_id", "volume_multiplier")
    return d.lines.join(files, "file_id").select(
        "item_id", money.apply_multiplier(F.col("eau"), F.col("volume_multiplier")).alias("eau")
    )


@query(
    "C4_item_fallback",
    f"SELECT item_id, CASE WHEN {sqlx.blank('raw_item')} AND {sqlx.present('raw_mpn')} THEN raw_mpn ELSE raw_item END AS item FROM raw_all",
    "raw_all",
)
def item_fallback(d):
    return d.raw.select("item_id", mapping.item_or_mpn(F.col("raw_item"), F.col("raw_mpn")).alias("item"))


@query(
    "C5_description_default",
    f"SELECT item_id, coalesce({sqlx.presence('raw_description')}, {sqlx.presence('raw_mpn')}, 'No description provided') AS description FROM raw_all",
    "raw_all",
)
def description_default(d):
    return d.raw.select("item_id", default_description(F.col("raw_description"), F.col("raw_mpn")).alias("description"))


@query(
    "C6_manufacturer_names",
    "SELECT item_id, coalesce(standardized_name, mfg_name) AS mfg_name FROM lines LEFT JOIN manufacturers ON mfg_name = original_name",
    "lines",
    "manufacturers",
)
def manufacturer(d):
    return mapping.standardize_names(d.lines, manufacturer_names(d.manufacturers)).select("item_id", "mfg_name")


def _with_demand(d):
    """Lines with demand (for files that asked for it) and market price of their item."""
    aml = d.aml.withColumnRenamed("item", "item_key")
    joined = lookup.lookup(d.lines, aml, {"item_key": text.strip(F.col("item"))})
    return joined.withColumn("demand", F.when(F.col("demand_lookup"), F.col("total_demand")))


_DEMAND = "(SELECT l.*, CASE WHEN demand_lookup THEN total_demand END AS demand, min_price FROM lines l LEFT JOIN aml a ON l.item = a.item)"


@query("C7_ear", f"SELECT item_id, CAST({sqlx.ear('demand', 'min_price')} AS DOUBLE) AS ear FROM {_DEMAND}", "lines", "aml")
def ear(d):
    return _with_demand(d).select("item_id", num(money.ear(F.col("demand"), F.col("min_price"))).alias("ear"))


@query("C8_ear_fallback", "SELECT item_id, ear_fallback FROM enriched", "enriched")
def ear_fallback(d):
    flag = money.ear_uses_fallback(F.col("demand"), F.col("min_price"))
    return _with_demand(d).select("item_id", flag.alias("ear_fallback"))


@query("C9_ear_status", "SELECT item_id, ear_status FROM enriched", "enriched")
def ear_status(d):
    value = money.ear(F.col("demand"), F.col("min_price"))
    return _with_demand(d).select("item_id", money.ear_status(value).alias("ear_status"))


@query("C10_normalize_scope", f"SELECT item_id, {sqlx.norm_scope('scope')} AS scope FROM lines", "lines")
def normalize(d):
    return d.lines.select("item_id", scope.normalize_scope(F.col("scope")).alias("scope"))


@query(
    "C11_resolve_scope",
    f"SELECT id, {sqlx.resolve('base_scope', 'auto_scope', 'true')} AS auto_mode, {sqlx.resolve('base_scope', 'auto_scope', 'false')} AS base_mode FROM refs_plain",
    "refs_plain",
)
def resolve(d):
    def resolved(auto: bool):
        return scope.resolve_scope(F.col("base_scope"), F.col("auto_scope"), F.lit(auto))

    return d.refs_plain.select("id", resolved(True).alias("auto_mode"), resolved(False).alias("base_mode"))


@query(
    "C12_quote_override",
    "SELECT item_id, CASE WHEN q.item IS NOT NULL AND l.item IS DISTINCT FROM l.mfg_partno THEN 'In scope' ELSE scope END AS scope "
    "FROM lines l LEFT JOIN last_quotes q ON l.item = q.item",
    "lines",
    "last_quotes",
)
def quote_override(d):
    quoted = lookup.flagged(d.lines, d.quotes.select("item"), "item", "quoted")
    own = ~F.col("item").eqNullSafe(F.col("mfg_partno"))
    return quoted.select("item_id", scope.override(F.col("scope"), F.col("quoted") & own).alias("scope"))


@query(
    "C13_cross_override",
    "SELECT item_id, CASE WHEN has_cross THEN 'In scope' ELSE scope END AS scope FROM enriched",
    "enriched",
)
def cross_override(d):
    from partloom.sources.side_tables import crosses_by_mpn

    crossed = lookup.with_cross(d.lines, crosses_by_mpn(d.crosses))
    return crossed.select("item_id", scope.override(F.col("scope"), F.col("has_cross")).alias("scope"))


@query(
    "C14_session_duration",
    "SELECT session_id, CASE WHEN ended_at IS NULL THEN CAST(floor(epoch_us(TIMESTAMP '2024-03-01') / 1000000.0 - epoch_us(started_at) / 1000000.0) AS BIGINT) "
    "ELSE duration_seconds END AS duration FROM sessions",
    "sessions",
)
def session_duration(d):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    return sessions.with_duration(sessions.sessions_from_events(d.logins), now).select("session_id", "duration")


@query(
    "C15_canonical_scope",
    f"SELECT id, {sqlx.canonical('base_scope')} AS base_scope, {sqlx.canonical('auto_scope')} AS auto_scope FROM refs_plain",
    "refs_plain",
)
def canonical(d):
    return d.refs_plain.select(
        "id", *[scope.canonical_scope(F.col(c)).alias(c) for c in ("base_scope", "auto_scope")]
    )


@query(
    "C16_share_band",
    f"SELECT file_id, commodity, p AS percent, {sqlx.band('p')} AS band FROM (SELECT file_id, commodity, {sqlx.percent('n', 'sum(n) OVER (PARTITION BY file_id)')} AS p "
    "FROM (SELECT file_id, commodity, count(*) AS n FROM lines GROUP BY 1, 2))",
    "lines",
)
def share_band(d):
    from pyspark.sql import Window

    counts = d.lines.groupBy("file_id", "commodity").count()
    share = money.share_percent(F.col("count"), F.sum("count").over(Window.partitionBy("file_id")))
    return counts.withColumn("percent", share).select(
        "file_id", "commodity", "percent", money.share_band(F.col("percent")).alias("band")
    )


@query("T1_expand_description", f"SELECT doc_id, {sqlx.expand('text')} AS expanded FROM documents")
def expand(d):
    return d.table("documents").select("doc_id", text.expand_description(F.col("text")).alias("expanded"))


@query(
    "T1_expand_line_description",
    f"SELECT item_id, {sqlx.expand(chr(39) + 'pcb, CONN ' + chr(39) + ' || description || ' + chr(39) + ', W-TO-B AC/DC &amp; RJ45' + chr(39))} AS expanded FROM lines",
    "lines",
)
def expand_lines(d):
    c = F.concat(F.lit("pcb, CONN "), "description", F.lit(", W-TO-B AC/DC &amp; RJ45"))
    return d.lines.select("item_id", text.expand_description(c).alias("expanded"))


@query(
    "T2_expansion_stable",
    f"SELECT doc_id, once = {sqlx.expand('once')} AS stable FROM (SELECT doc_id, {sqlx.expand('text')} AS once FROM documents)",
)
def expansion_stable(d):
    return d.table("documents").select("doc_id", text.expansion_is_stable(F.col("text")).alias("stable"))


_RAW_TEXT = sqlx.line_text(
    "raw_item", "raw_mpn", "raw_description", "raw_mfg", "raw_global_code", ("raw_level1", "raw_level2", "raw_level3")
)


@query("T3_line_text", f"SELECT item_id, {_RAW_TEXT} AS text FROM raw", "raw")
def line_text(d):
    from partloom.operators.classify import embedding_text

    return mapping.apply_mapping(d.sheets, d.mapped_files).select("item_id", embedding_text().alias("text"))


@query("T4_stored_line_text", f"SELECT item_id, {sqlx.stored_text()} AS text FROM lines", "lines")
def stored_text(d):
    return d.lines.select("item_id", corrections.own_text().alias("text"))


@query("T5_reference_text", f"SELECT id, {sqlx.ref_text()} AS text FROM refs_plain", "refs_plain")
def reference_text(d):
    return d.refs_plain.select("id", text.reference_text().alias("text"))


@query("T6_text_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents")
def text_hash(d):
    return d.table("documents").select("doc_id", text.text_hash(F.col("text")).alias("h"))


@query(
    "T7_sanitize",
    f"SELECT doc_id, substr({sqlx.strip('text')}, 1, 1000) AS sent, "
    "CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM documents",
)
def sanitize(d):
    return d.table("documents").select(
        "doc_id", text.embedding_input(F.col("text")).alias("sent"), text.sample_cell(F.col("text")).alias("shown")
    )


@query("T8_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def tokens(d):
    return d.table("documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


_PAIR = "(SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)"


def _first_of_label(d):
    emb = d.table("embeddings")
    first = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return emb.join(first, "label")


@query(
    "T9_dot",
    f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(first AS DOUBLE[])), 9) AS dot FROM embeddings JOIN {_PAIR} USING (label)",
)
def dot(d):
    return _first_of_label(d).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("first")), 9).alias("dot"))


@query(
    "T10_cosine",
    f"SELECT vec_id, round({sqlx.cosine('embedding', 'first')}, 9) AS cosine FROM embeddings JOIN {_PAIR} USING (label)",
)
def cosine(d):
    value = vectors.cosine(F.col("embedding"), F.col("first"))
    return _first_of_label(d).select("vec_id", F.round(value, 9).alias("cosine"))


@query("T11_similarity_percent", "SELECT key, ref_id, round(sim * 100, 2) AS percent, rank FROM ranked", "ranked")
def similarity_percent(d):
    from partloom.operators.nearest import similar_references

    return similar_references(d.vectors, d.centroids).select(
        "key", "ref_id", "percent", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "T12_sample_mpns",
    "SELECT id, array_to_string(list_slice(string_split(typical_mpns, ','), 1, 3), ', ') AS mpns FROM refs_plain",
    "refs_plain",
)
def sample_mpns(d):
    return d.refs_plain.select("id", text.sample_mpns(F.col("typical_mpns")).alias("mpns"))


@query(
    "T14_parse_decision",
    "SELECT item_id, should_correct, confidence_level, current_assignment_correct, recommended_commodity, recommended_scope FROM decisions",
    "decisions",
)
def parse_decision(d):
    return corrections.parsed_decisions(d.responses).drop("reasoning", "evidence")


@query(
    "T14_parse_conversations",
    "SELECT conv_id, turn, regexp_extract(text, '(?s)```json\\s*(\\{.*?\\})\\s*```', 1) = '' "
    "AND regexp_extract(text, '(?s).*(\\{.*\\})', 1) = '' AS defaulted FROM conversations",
)
def parse_conversations(d):
    plain = corrections.decision_text(F.col("text")) == ""
    return d.table("conversations").select("conv_id", "turn", plain.alias("defaulted"))


_KIND = "(turn + conv_id) % 4"


@query(
    "T14_decisions_in_talk",
    f"""SELECT conv_id, turn, r < 2 AS should_correct, CASE WHEN r < 2 THEN 'high' ELSE 'low' END AS confidence_level, CASE WHEN r < 2 THEN role END AS recommended_commodity
  FROM (SELECT conv_id, turn, role, CASE WHEN text IS NULL THEN 2 ELSE {_KIND} END AS r FROM conversations)""",
)
def decisions_in_talk(d):
    """Turns with a decision in a fence between words, behind words, cut off in the middle, or without one."""
    decision = F.concat(F.lit('{"should_correct": true, "confidence_level": "high", "recommended_commodity": "'), "role", F.lit('"'))
    # The turn's own braces and fences would be decisions of their own.
    words = F.translate("text", "{}`", "   ")
    kind = F.expr(_KIND)
    answer = (
        F.when(kind == 0, F.concat(words, F.lit("\n```json\n"), decision, F.lit("}\n```\n"), words))
        .when(kind == 1, F.concat(words, F.lit(" {so} "), words, decision, F.lit("}")))
        .when(kind == 2, F.concat(words, decision))
        .otherwise(words)
    )
    turns = d.table("conversations").select("conv_id", "turn", corrections.parse_decision(answer).alias("p"))
    return turns.select("conv_id", "turn", "p.should_correct", "p.confidence_level", "p.recommended_commodity")


@query(
    "T15_stand_in_embedding",
    "SELECT doc_id, round(list_sum(CAST(v AS DOUBLE[])), 5) AS total, round(CAST(v[1] AS DOUBLE), 5) AS head, round(CAST(v[64] AS DOUBLE), 5) AS tail "
    f"FROM (SELECT doc_id, {sqlx.stand_in('text')} AS v FROM documents)",
)
def stand_in(d):
    v = F.col("v")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return d.table("documents").select("doc_id", vectors.stand_in_embedding(F.col("text")).alias("v")).select(
        "doc_id",
        F.round(total, 5).alias("total"),
        F.round(v[0].cast("double"), 5).alias("head"),
        F.round(v[63].cast("double"), 5).alias("tail"),
    )


@query("T16_row_map", "SELECT item_id, raw_item AS item, raw_eau AS eau FROM raw", "raw")
def row_map(d):
    """Zip of headers and cells, read back by the header each layout has for a field."""
    maps = row_maps(d.sheets, d.file_headers)
    names = {raw: [F.element_at("cells", f[raw]) for f in LAYOUTS.values()] for raw in ("raw_item", "raw_eau")}
    return maps.select("item_id", F.coalesce(*names["raw_item"]).alias("item"), F.coalesce(*names["raw_eau"]).alias("eau"))


@query("T18_category_path", "SELECT id, concat_ws(' > ', level1, level2) AS category FROM refs_plain", "refs_plain")
def category(d):
    return d.refs_plain.select("id", text.category_path(F.col("level1"), F.col("level2")).alias("category"))
