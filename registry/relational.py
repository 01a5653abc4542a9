"""Filters, joins, set operations, windows and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import rules, text
from partloom.functions.scope import resolve_scope
from partloom.operators import corrections, filters, lookup, mapping, remap, reuse, sessions, topk
from partloom.operators.analytics import commodity_levels, export_filter, export_filter_json
from partloom.operators.nearest import nearest_references
from partloom.plans.enrich import enrich
from partloom.sources import catalogue, side_tables
from registry import sqlx
from registry.core import num, query, sql_stamp, stamp
from registry.scans import _GENERIC, _some_generic

# --- filters ------------------------------------------------------------------------------------------


@query(
    "F1_skip_references",
    f"SELECT id FROM (SELECT id, level1, {_GENERIC} AS level3 FROM refs_plain) WHERE level1 IS DISTINCT FROM level3 AND level3 <> 'Super Capacitor Module'",
    "refs_plain",
)
def skip_references(d):
    return _some_generic(d).where(~catalogue.is_skipped(F.col("level1"), F.col("level3"))).select("id")


def _ilike(columns: list[str], pattern: str) -> str:
    return "(" + " OR ".join(f"coalesce({c} ILIKE '%{pattern}%', false)" for c in columns) + ")"


@query("F2_search_catalogue", f"SELECT id FROM refs_plain WHERE {_ilike(filters.SEARCHED, 'r_d w')}", "refs_plain")
def search(d):
    return filters.search_catalogue(d.refs_plain, "r_d w").select("id")


@query("F3_scope_filter", "SELECT id FROM refs_plain WHERE base_scope = 'In Scope'", "refs_plain")
def scope_filter(d):
    return filters.with_base_scope(d.refs_plain, "In Scope").select("id")


@query("F4_search_lines", f"SELECT item_id FROM lines WHERE {_ilike(['item', 'description', 'commodity'], 'GEAR PROMO')}", "lines")
def search_lines(d):
    return filters.search_lines(d.lines, "GEAR PROMO").select("item_id")


_SCOPED = f"scope IS NOT NULL AND {sqlx.norm_scope('scope')} = 'Out of scope'"
_DATA = "(std_cost > 0 OR last_purchase_price > 0 OR last_po > 0) AND mfg_partno IS NOT NULL AND mfg_partno <> '' AND eau > 0"


@query("F5_export_filters", f"SELECT item_id FROM lines WHERE {_SCOPED} AND commodity IN ('red bolt', 'RED BOLT', 'blue gear') AND {_DATA}", "lines")
def export_filters(d):
    return export_filter(
        d.lines, ["Out of scope"], ["red bolt", "RED BOLT", "blue gear"], ["with_prices", "with_cross_refs", "with_demand"]
    ).select("item_id")


@query(
    "F6_without_embedding",
    "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0",
)
def without_embedding(d):
    """Documents stand for references: unlabelled ones have no vector, those of low quality an empty one."""
    labelled = d.table("documents").select("doc_id").join(d.table("labels"), "doc_id", "left")
    empty = F.array().cast("array<float>")
    vector = F.when(F.col("quality") == 1, F.array(F.lit(1.0).cast("float"))).when(F.col("quality") == 0, empty)
    return catalogue.without_embedding(labelled.withColumn("embedding", vector)).select("doc_id")


@query(
    "F7_session_scopes",
    "SELECT session_id, ended_at IS NULL AS active, started_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AS in_range FROM sessions",
    "sessions",
)
def session_scopes(d):
    table = sessions.sessions_from_events(d.logins)
    active = sessions.active(table).select("session_id", F.lit(True).alias("active"))
    ended = sessions.finished(table).select("session_id", F.lit(False).alias("active"))
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05", "2024-01-20"))
    inside = sessions.in_range(table, start, end).select("session_id", F.lit(True).alias("in_range"))
    return active.unionByName(ended).join(inside, "session_id", "left").fillna(False, ["in_range"])


@query("F8_file_verdicts", f"SELECT file_id, bool_and(NOT {sqlx.blank('item')}) AS valid FROM standard GROUP BY 1", "standard")
def verdicts(d):
    from partloom.plans.standardize import standardize

    return mapping.file_verdicts(standardize(d.sheets, d.mapped_files, d.manufacturers)).select("file_id", "valid")


_CELL = """CASE WHEN line_no % 13 = 3 THEN 1 ELSE 0 END AS no_item, CASE WHEN line_no % 7 = 1 THEN 1 ELSE 0 END AS cost, CASE WHEN line_no % 11 = 2 THEN 1 ELSE 0 END AS amount,
    CASE WHEN line_no % 17 = 4 THEN 1 ELSE 0 END AS wide"""


@query(
    "F8_line_problems",
    f"""SELECT item_id, concat_ws('; ', CASE WHEN wide = 1 THEN 'record too wide' END, CASE WHEN no_item = 1 OR ({sqlx.blank('raw_item')} AND {sqlx.blank('raw_mpn')}) THEN 'item missing' END,
    CASE WHEN cost = 1 THEN 'std_cost not a number' END, CASE WHEN amount = 1 THEN 'eau not a number' END) AS problems
  FROM (SELECT *, {_CELL} FROM raw_all)""",
    "raw_all",
)
def broken_lines(d):
    """Lines with numbers beyond their type, records too wide and missing items."""
    at = lambda k, n: F.col("line_no") % k == n
    none = F.lit("")
    broken = d.raw.withColumns(
        {
            "raw_item": F.when(at(13, 3), none).otherwise(F.col("raw_item")),
            "raw_mpn": F.when(at(13, 3), none).otherwise(F.col("raw_mpn")),
            "raw_std_cost": F.when(at(7, 1), F.repeat(F.lit("9"), 60)).otherwise(F.col("raw_std_cost")),
            "raw_eau": F.when(at(11, 2), F.repeat(F.lit("9"), 40)).otherwise(F.col("raw_eau")),
            "volume_multiplier": F.lit(1),
            "auto_mode": F.lit(False),
        }
    )
    problems = mapping.line_problems(at(17, 4))
    return mapping.standard_columns(broken).select("item_id", F.array_join(problems, "; ").alias("problems"))


@query(
    "F8_file_and_session_rows",
    """SELECT 'file' AS kind, CAST(file_id AS VARCHAR) AS id, concat_ws('; ', CASE WHEN file_id % 5 = 0 THEN 'filename missing' END, CASE WHEN file_id % 3 = 0 THEN 'status unknown' END) AS problems FROM files
  UNION ALL SELECT 'session', CAST(event_id AS VARCHAR), concat_ws('; ', CASE WHEN event_id % 5 = 0 THEN 'start missing' END, CASE WHEN event_id % 7 = 0 THEN 'reason unknown' END) FROM events""",
    "files",
)
def odd_rows(d):
    """File rows without a name or with an unknown status, session rows without a start or with an unknown reason."""
    name, status = F.when(F.col("file_id") % 5 != 0, "a.csv").otherwise(" "), F.when(F.col("file_id") % 3 == 0, "odd").otherwise(F.col("status"))
    files = d.files.withColumns({"original_filename": name, "status": status})
    key = F.col("event_id")
    reason = F.when(key % 7 == 0, "bored").when(key % 2 == 0, "manual")
    events = d.table("events").withColumns({"started_at": F.when(key % 5 != 0, F.col("ts")), "sign_out_reason": reason})
    shown = lambda df, kind, i, problems: df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.array_join(problems, "; ").alias("problems"))
    return shown(files, "file", "file_id", filters.file_problems()).unionByName(shown(events, "session", "event_id", filters.session_problems()))


@query(
    "F9_little_context",
    r"SELECT doc_id, length(text) < 10 OR len(list_filter(regexp_split_to_array(text, '[,;\s\-_|/]+'), lambda w: length(w) >= 3)) < 2 AS little FROM documents",
)
def little_context(d):
    return d.table("documents").select("doc_id", text.has_little_context(F.col("text")).alias("little"))


@query(
    "F10_autocomplete",
    f"SELECT id, level3 AS text, base_scope AS scope FROM refs_plain WHERE {_ilike(filters.SEARCHED, 'gear')} ORDER BY id LIMIT 20",
    "refs_plain",
)
def autocomplete(d):
    return filters.autocomplete(d.refs_plain, "gear")


@query(
    "F11_sibling_lines",
    """SELECT item_id, sibling_id FROM (SELECT a.item_id, b.item_id AS sibling_id, row_number() OVER (PARTITION BY a.item_id ORDER BY b.line_no) AS n
    FROM lines a JOIN (SELECT * FROM lines WHERE description ILIKE '%RED%' AND description ILIKE '%bolt%') b
    ON a.file_id = b.file_id AND a.item_id <> b.item_id) WHERE n <= 5""",
    "lines",
)
def siblings(d):
    return filters.sibling_lines(d.lines, d.lines, ["RED", "bolt"])


@query("F12_visible_files", "SELECT file_id, 'admin' AS viewer FROM files UNION ALL SELECT file_id, 'user' FROM files WHERE user_id = 3", "files")
def visible(d):
    everything = filters.files_for(d.files, 0, True).select("file_id", F.lit("admin").alias("viewer"))
    return everything.unionByName(filters.files_for(d.files, 3, False).select("file_id", F.lit("user").alias("viewer")))


@query("F13_key_hygiene", "SELECT DISTINCT mfg_partno FROM lines WHERE mfg_partno IS NOT NULL", "lines")
def hygiene(d):
    return side_tables.key_hygiene(d.lines, "mfg_partno")


# --- joins --------------------------------------------------------------------------------------------


@query(
    "J1_exact_commodity",
    f"SELECT item_id, r.id AS ref_id, {sqlx.resolve('r.base_scope', 'r.auto_scope', 'auto_mode')} AS scope FROM lines LEFT JOIN ref_by_level3 ON lower(commodity) = k",
    "lines",
    "ref_by_level3",
)
def exact(d):
    found = lookup.with_commodity(d.lines, d.refs_plain, F.col("commodity"))
    return found.select("item_id", F.col("reference.id").alias("ref_id"), lookup.reference_scope(F.col("auto_mode")).alias("scope"))


@query(
    "J1_exact_global_code",
    f"SELECT item_id, r.id AS ref_id, {sqlx.resolve('r.base_scope', 'r.auto_scope', 'file_id % 2 = 1')} AS scope FROM raw_all LEFT JOIN ref_by_code ON lower(raw_global_code) = k",
    "raw_all",
    "ref_by_code",
)
def exact_code(d):
    found = lookup.with_commodity(d.raw, d.refs_plain, F.col("raw_global_code"), F.lit("global_code"))
    auto = F.col("file_id") % 2 == 1
    return found.select(
        "item_id",
        F.col("reference.id").alias("ref_id"),
        resolve_scope(F.col("reference.base_scope"), F.col("reference.auto_scope"), auto).alias("scope"),
    )


@query(
    "J2_commodity_batch",
    "SELECT name, r.id AS ref_id, CASE WHEN lower(r.base_scope) = 'in scope' THEN 'In scope' ELSE 'Out of scope' END AS scope "
    "FROM (SELECT DISTINCT commodity AS name FROM lines) LEFT JOIN ref_last ON lower(name) = k",
    "lines",
    "ref_last",
)
def batch(d):
    names = d.lines.select(F.col("commodity").alias("name"))
    return lookup.commodity_batch(names, d.refs_plain).select("name", F.col("reference.id").alias("ref_id"), "scope")


@query("J3_has_cross", "SELECT item_id, has_cross FROM enriched", "enriched")
def has_cross(d):
    return lookup.with_cross(d.lines, side_tables.crosses_by_mpn(d.crosses)).select("item_id", "has_cross")


@query("J4_cross_part", "SELECT item_id, cross_mpn FROM enriched", "enriched")
def cross_part(d):
    return lookup.with_cross(d.lines, side_tables.crosses_by_mpn(d.crosses)).select("item_id", "cross_mpn")


_CHEAPEST = """(SELECT *, row_number() OVER (PARTITION BY cross_ref_mpn, supplier_pn, cross_ref_mfg ORDER BY house_cost ASC NULLS FIRST, house_mpn) AS rn
  FROM crosses WHERE component_grade = 'COMMERCIAL' AND house_mpn IS NOT NULL AND trim(house_mpn) <> '' AND cross_ref_mpn IS NOT NULL)"""


@query(
    "J5_best_cross",
    f"""SELECT item_id, supplier_pn, b.house_mpn, CAST(house_cost AS DOUBLE) AS house_cost, cross_ref_mfg FROM lines LEFT JOIN
    (SELECT * FROM {_CHEAPEST} WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY cross_ref_mpn ORDER BY supplier_pn, cross_ref_mfg) = 1) b ON mfg_partno = b.cross_ref_mpn""",
    "lines",
    "crosses",
)
def best_cross(d):
    best = side_tables.best_cross(d.crosses, rules.GRADE_COMMERCIAL)
    joined = lookup.lookup(d.lines, best, {"cross_ref_mpn": F.col("mfg_partno")})
    return joined.select("item_id", "supplier_pn", "house_mpn", num("house_cost").alias("house_cost"), "cross_ref_mfg")


@query(
    "J5_best_cross_by_grade",
    """SELECT item_id, supplier_pn, b.house_mpn, CAST(house_cost AS DOUBLE) AS house_cost, cross_ref_mfg FROM lines LEFT JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cross_ref_mpn, component_grade, supplier_pn, cross_ref_mfg ORDER BY house_cost ASC NULLS FIRST, house_mpn) AS rn
    FROM crosses WHERE house_mpn IS NOT NULL AND trim(house_mpn) <> '' AND cross_ref_mpn IS NOT NULL) WHERE rn = 1
    QUALIFY row_number() OVER (PARTITION BY cross_ref_mpn, component_grade ORDER BY supplier_pn, cross_ref_mfg) = 1) b
    ON mfg_partno = b.cross_ref_mpn AND grade = b.component_grade""",
    "lines",
    "crosses",
)
def best_cross_by_grade(d):
    """Crosses of the grade of each line's file; ``J5_best_cross`` looks up one grade for all."""
    best = side_tables.best_cross_by_grade(d.crosses).withColumnRenamed("component_grade", "grade_key")
    joined = lookup.lookup(d.lines, best, {"cross_ref_mpn": F.col("mfg_partno"), "grade_key": F.col("grade")})
    return joined.select("item_id", "supplier_pn", "house_mpn", num("house_cost").alias("house_cost"), "cross_ref_mfg")


@query(
    "J6_quote_lookup",
    f"SELECT item_id, previously_quoted, {sql_stamp('quote_date')} AS quote_date, previous_quote_number, quoted_mpn FROM enriched",
    "enriched",
)
def quote_lookup(d):
    side = side_tables.latest_quotes(d.quotes).withColumnRenamed("item", "item_key").withColumn("item_quoted", F.lit(True))
    joined = lookup.lookup(d.lines, side, {"item_key": F.col("item")})
    return joined.withColumns(lookup.quote_columns(F.col("item"), F.col("mfg_partno"), F.col("item_quoted"))).select(
        "item_id", "previously_quoted", stamp("quote_date").alias("quote_date"), "previous_quote_number", "quoted_mpn"
    )


def _demand(d):
    side = side_tables.demand_by_item(d.aml).withColumnRenamed("item", "item_key")
    return lookup.lookup(d.lines, side, {"item_key": text.strip(F.col("item"))})


@query("J7_total_demand", "SELECT item_id, demand AS total_demand FROM enriched", "enriched")
def total_demand(d):
    return _demand(d).select("item_id", F.when(F.col("demand_lookup"), F.col("total_demand")).alias("total_demand"))


@query("J8_min_price", "SELECT item_id, CAST(min_price AS DOUBLE) AS min_price FROM enriched", "enriched")
def min_price(d):
    return _demand(d).select("item_id", num("min_price").alias("min_price"))


@query("J9_quoted_items", "SELECT item_id, item_quoted FROM enriched", "enriched")
def quoted_items(d):
    return lookup.flagged(d.lines, d.quotes.select("item"), "item", "item_quoted").select("item_id", "item_quoted")


@query("J10_active_cross", "SELECT item_id, active_cross FROM enriched", "enriched")
def active_cross(d):
    parts = lookup.active_cross_parts(d.crosses).select(
        F.col("cross_ref_mpn").alias("mpn_key"), F.col("component_grade").alias("grade_key"), F.lit(True).alias("active_cross")
    )
    joined = lookup.lookup(d.lines, parts, {"mpn_key": F.col("mfg_partno"), "grade_key": F.col("grade")})
    return joined.select("item_id", F.coalesce("active_cross", F.lit(False)).alias("active_cross"))


def _stored(d):
    """Stored lines with vectors: the lines whose part has quantity figures of its own."""
    from partloom.functions.vectors import stand_in_embedding

    hashed = d.lines.withColumn("text", corrections.own_text())
    vector = F.when(F.col("eau").isNotNull() & (F.col("std_cost") > 0), stand_in_embedding(F.col("item")))
    return hashed.withColumns({"text_hash": text.text_hash(F.col("text")), "embedding": vector})


_STORED = f"(SELECT *, {sqlx.stored_text()} AS text, coalesce(eau IS NOT NULL AND std_cost > 0, false) AS has_vector FROM lines)"


@query(
    "J11_reuse_embeddings",
    f"""SELECT sha256(text) AS text_hash, bool_or(has_vector) AS known FROM {_STORED} GROUP BY 1""",
    "lines",
)
def reuse_embeddings(d):
    stored = _stored(d)
    matched = reuse.reuse_embeddings(reuse.distinct_texts(stored, keyed=True), stored)
    return matched.select("text_hash", F.col("embedding").isNotNull().alias("known"))


@query(
    "J11b_reuse_by_description",
    f"SELECT description, arg_min(item, line_no) AS from_item FROM {_STORED} WHERE has_vector GROUP BY 1",
    "lines",
)
def reuse_by_description(d):
    """The vector is that of the first stored line; its item stands for it here."""
    stored = _stored(d).withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("item")))
    return reuse.reuse_by_description(d.lines, stored).select("description", F.col("embedding").alias("from_item"))


@query("J12_nearest_reference", "SELECT key, ref_id, round(sim, 6) AS similarity FROM ranked WHERE rank = 1", "ranked")
def nearest(d):
    return nearest_references(d.vectors, d.centroids).select("key", "ref_id", F.round("similarity", 6).alias("similarity"))


@query("J12_nearest_blocked", "SELECT key, ref_id, rank FROM ranked WHERE rank <= 3", "ranked")
def nearest_blocked(d):
    """The same search with the catalogue cut into small blocks."""
    found = nearest_references(d.vectors, d.centroids, k=3, block_bytes=2048)
    return found.select("key", "ref_id", F.col("rank").cast("bigint").alias("rank"))


def _with(sql_text: str, extra: str) -> str:
    """SQL with further frames of its own."""
    return f"SELECT * FROM (WITH {extra} {sql_text})"


_REF_PAIRS = """pairs AS (SELECT vec_id AS key, id AS ref_id, round(list_inner_product(e.v, r.v) / (e.n * r.n), 12) AS sim
  FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(v, v)) AS n FROM embeddings) e
  CROSS JOIN (SELECT id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(v, v)) AS n FROM refs) r)"""


@query(
    "J12_nearest_of_catalogue",
    _with(
        "SELECT key, ref_id, rank, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sim DESC, ref_id) AS rank FROM pairs) WHERE rank <= 3",
        _REF_PAIRS,
    ),
    "refs",
)
def nearest_of_catalogue(d):
    """All vectors against the whole catalogue, in several blocks and groups."""
    catalogue = d.refs.select(F.col("id").alias("ref_id"), F.col("embedding").alias("vec"))
    found = nearest_references(d.vectors, catalogue, k=3, block_bytes=16 << 10, group=4)
    return found.select("key", "ref_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


def _edits(d):
    """Edits of the old lines of the part with small quantities; some are empty."""
    small = d.lines.where(F.col("eau") < 25)
    new = F.when(F.col("std_cost").isNull(), "").otherwise(F.concat(F.lit("red "), F.element_at(F.split("commodity", " "), 2)))
    return small.select("file_id", "item_id", new.alias("new_commodity"))


def _edited_lines(d):
    """Old lines with an edit that is not empty, as far as matching them asks for."""
    stored = d.lines.select("file_id", "item_id", "item", "description")
    return _edits(d).where(F.col("new_commodity") != "").join(stored, ["file_id", "item_id"])


_EDIT_KEYS = """edits AS (SELECT file_id, item_id, line_no, item, description, 'red ' || split_part(commodity, ' ', 2) AS new_commodity
    FROM lines WHERE eau < 25 AND std_cost IS NOT NULL),
  edit_keys AS (SELECT file_id, k, arg_min(new_commodity, line_no) AS c FROM (SELECT file_id, item AS k, line_no, new_commodity FROM edits
    UNION ALL SELECT file_id, description, line_no, new_commodity FROM edits
    UNION ALL SELECT file_id, item || '|' || description, line_no, new_commodity FROM edits) GROUP BY 1, 2)"""


@query(
    "J13_line_remap",
    _with(
        f"""SELECT l.item_id, coalesce(a.c, b.c, e.c, l.commodity) AS commodity, CASE WHEN coalesce(a.c, b.c, e.c) IS NULL THEN l.scope ELSE
    {sqlx.resolve('r.base_scope', 'r.auto_scope', 'l.auto_mode')} END AS scope FROM lines l
    LEFT JOIN edit_keys a ON l.file_id = a.file_id AND l.item = a.k LEFT JOIN edit_keys b ON l.file_id = b.file_id AND l.description = b.k
    LEFT JOIN edit_keys e ON l.file_id = e.file_id AND l.item || '|' || l.description = e.k
    LEFT JOIN ref_by_level3 ON lower(coalesce(a.c, b.c, e.c)) = ref_by_level3.k""",
        _EDIT_KEYS,
    ),
    "lines",
    "ref_by_level3",
)
def line_remap(d):
    return remap.remap_lines(d.lines, d.refs_plain, d.lines, _edits(d)).select("item_id", "commodity", "scope")


def _changes(d):
    """Every second word gets a new colour in the files of auto mode; blank targets keep the commodity."""
    named = d.lines.where("auto_mode").select("file_id", F.col("commodity").alias("old_commodity")).distinct()
    word = F.element_at(F.split("old_commodity", " "), 2)
    return named.withColumn("new_commodity", F.when(F.length(word) % 2 == 0, F.concat(F.lit("blue "), word)).otherwise(" "))


_BULK = """bulk AS (SELECT DISTINCT file_id, commodity AS old, 'blue ' || split_part(commodity, ' ', 2) AS new FROM lines
  WHERE auto_mode AND length(split_part(commodity, ' ', 2)) % 2 = 0)"""


@query(
    "J14_bulk_change",
    _with(
        f"""SELECT l.item_id, coalesce(b.new, l.commodity) AS commodity, CASE WHEN b.new IS NULL THEN l.scope ELSE
    {sqlx.resolve('r.base_scope', 'r.auto_scope', 'l.auto_mode')} END AS scope FROM lines l
    LEFT JOIN bulk b ON l.file_id = b.file_id AND l.commodity = b.old LEFT JOIN ref_by_level3 ON lower(b.new) = k""",
        _BULK,
    ),
    "lines",
    "ref_by_level3",
)
def bulk_change(d):
    return remap.remap_lines(d.lines, d.refs_plain, changes=_changes(d)).select("item_id", "commodity", "scope")


_LEVELS = """SELECT file_id, commodity, coalesce(CASE WHEN on_first THEN r.level1 END, 'Unknown Level 1') AS level1
  FROM (SELECT file_id, commodity, bool_or(duplication_flag = 'Unique') AS on_first FROM enriched GROUP BY 1, 2) LEFT JOIN ref_last ON lower(commodity) = k"""


@query("J15_commodity_levels", _LEVELS, "enriched", "ref_last")
def levels(d):
    return commodity_levels(enrich(d.lines, d.quotes, d.aml, d.crosses), d.refs_plain)


_APPLIED = "should_correct AND confidence_level = 'high'"


@query(
    "J16_apply_corrections",
    f"""SELECT item_id, CASE WHEN {_APPLIED} THEN recommended_commodity ELSE commodity END AS commodity,
    CASE WHEN {_APPLIED} THEN recommended_scope ELSE scope END AS scope, {_APPLIED} AS corrected FROM lines JOIN decisions USING (item_id)""",
    "lines",
    "decisions",
)
def apply_corrections(d):
    decisions = corrections.parsed_decisions(d.responses)
    return corrections.apply_corrections(d.lines, decisions).select("item_id", "commodity", "scope", "corrected")


@query(
    "J17_pick_list",
    "SELECT level3, arg_max({'s': base_scope}, id).s AS base_scope FROM refs_plain GROUP BY 1",
    "refs_plain",
)
def pick_list(d):
    return lookup.pick_list(d.refs_plain)


@query(
    "J18_users_files_sessions",
    "SELECT user_id, 'file' AS kind, file_id AS id FROM files JOIN users USING (user_id) UNION ALL SELECT user_id, 'session', session_id FROM sessions JOIN users USING (user_id)",
    "files",
    "users",
    "sessions",
)
def users_files_sessions(d):
    """Files and sessions of every user, one row each; never files times sessions."""
    owned = filters.with_owner(d.files, d.users).select("user_id", F.lit("file").alias("kind"), F.col("file_id").alias("id"))
    table = filters.with_owner(sessions.sessions_from_events(d.logins), d.users)
    return owned.unionByName(table.select("user_id", F.lit("session").alias("kind"), F.col("session_id").alias("id")))


_TOPQ = "(SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY eau DESC, line_no) AS rank FROM lines WHERE eau IS NOT NULL AND eau <> 0)"


@query(
    "J19_candidate_in_top",
    f"SELECT item_id, item_id IN (SELECT item_id FROM {_TOPQ} WHERE rank <= 10) AS in_top FROM lines",
    "lines",
)
def in_top(d):
    return topk.candidate_in_top(d.lines, d.lines.select("item_id"))


# --- set operations -----------------------------------------------------------------------------------


@query(
    "U1_matched_old_lines",
    _with(
        """SELECT item_id AS old_id FROM edits e WHERE (file_id, item) IN (SELECT (file_id, item) FROM lines WHERE auto_mode)
    OR (file_id, description) IN (SELECT (file_id, description) FROM lines WHERE auto_mode)""",
        _EDIT_KEYS,
    ),
    "lines",
)
def matched_old_lines(d):
    """Edited old lines that some line in auto mode can take: matched by any key, each old line once."""
    old = _edited_lines(d)
    return remap.matched_previous(d.lines.where("auto_mode"), old).select(F.col("item_id").alias("old_id"))


@query(
    "U1_matched_by_all_lines",
    _with(
        """SELECT item_id AS old_id FROM edits e WHERE (file_id, item) IN (SELECT (file_id, item) FROM lines)
    OR (file_id, description) IN (SELECT (file_id, description) FROM lines)""",
        _EDIT_KEYS,
    ),
    "lines",
)
def matched_by_all_lines(d):
    """Edited old lines that some line of any file can take; ``U1_matched_old_lines`` asks the lines in auto mode only."""
    old = _edited_lines(d)
    return remap.matched_previous(d.lines, old).select(F.col("item_id").alias("old_id"))


@query(
    "U2_active_parts",
    "SELECT DISTINCT cross_ref_mpn, component_grade FROM crosses WHERE status = 'ACTIVE' AND house_mpn IS NOT NULL AND cross_ref_mpn IS NOT NULL",
    "crosses",
)
def active_parts(d):
    return lookup.active_cross_parts(d.crosses)


@query("U3_distinct_pairs", "SELECT DISTINCT item, mfg_partno FROM lines WHERE mfg_partno IS NOT NULL", "lines")
def distinct_pairs(d):
    return d.lines.where(text.is_present(F.col("item")) & text.is_present(F.col("mfg_partno"))).select("item", "mfg_partno").distinct()


@query("U4_raw_scopes", f"SELECT DISTINCT scope FROM lines WHERE scope IS NOT NULL AND {sqlx.norm_scope('scope')} = 'In scope'", "lines")
def raw_scopes(d):
    return export_filter(d.lines, ["In scope"]).select("scope").distinct()


# --- windows ------------------------------------------------------------------------------------------


@query(
    "W1_duplicate_flag",
    "SELECT item_id, CASE WHEN row_number() OVER (PARTITION BY file_id, item ORDER BY line_no) = 1 THEN 'Unique' ELSE 'AML' END AS flag FROM lines",
    "lines",
)
def duplicate_flag(d):
    firsts = d.lines.groupBy("file_id", "item").agg(F.min("line_no").alias("first_line_no"))
    joined = lookup.with_item_facts(d.lines, firsts)
    first = F.col("line_no") == F.col("first_line_no")
    return joined.select("item_id", F.when(first, rules.FIRST_FLAG).otherwise(rules.REPEAT_FLAG).alias("flag"))


@query("W2_latest_quote", "SELECT item, quote_number FROM last_quotes", "last_quotes")
def latest_quote(d):
    return side_tables.latest_quotes(d.quotes).select("item", "quote_number")


@query(
    "W3_cheapest_cross",
    f"SELECT cross_ref_mpn, supplier_pn, house_mpn, CAST(house_cost AS DOUBLE) AS house_cost, cross_ref_mfg FROM {_CHEAPEST} WHERE rn = 1",
    "crosses",
)
def cheapest_cross(d):
    return side_tables.cheapest_crosses(d.crosses, rules.GRADE_COMMERCIAL).withColumn("house_cost", num("house_cost"))


@query(
    "W4_current_session",
    f"SELECT user_id, session_id, {sql_stamp('started_at')} AS started_at FROM sessions WHERE ended_at IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, session_id DESC) = 1",
    "sessions",
)
def current_session(d):
    return sessions.current_sessions(sessions.sessions_from_events(d.logins)).withColumn("started_at", stamp("started_at"))


@query("W5_similar_rank", "SELECT key, ref_id, rank FROM ranked WHERE rank <= 5", "ranked")
def similar_rank(d):
    found = nearest_references(d.vectors, d.centroids, k=5)
    return found.select("key", "ref_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "W6_next_login",
    f"SELECT event_id, {sql_stamp('lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS next_login FROM logins WHERE kind = 'login'",
    "logins",
)
def next_login(d):
    moves = sessions.next_event(d.logins.where(F.col("kind") == "login"))
    return moves.select("event_id", stamp("next_ts").alias("next_login"))


# --- rankings -----------------------------------------------------------------------------------------


@query(
    "K1_top_ear_lines",
    f"SELECT file_id, item_id, CAST(v AS DOUBLE) AS own_ear, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY v DESC, line_no) AS rank "
    f"FROM (SELECT *, eau * {sqlx.lowest_price()} AS v FROM lines WHERE eau > 0 AND {sqlx.lowest_price()} IS NOT NULL)) WHERE rank <= 10",
    "lines",
)
def top_ear(d):
    return topk.top_ear_lines(d.lines).select("file_id", "item_id", num("own_ear").alias("own_ear"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "K1_top_ear_overall",
    f"SELECT item_id, CAST(eau * {sqlx.lowest_price()} AS DOUBLE) AS own_ear FROM lines WHERE eau > 0 AND {sqlx.lowest_price()} IS NOT NULL "
    f"ORDER BY eau * {sqlx.lowest_price()} DESC, file_id, line_no LIMIT 10",
    "lines",
)
def top_overall(d):
    return topk.top_ear_lines_overall(d.lines).select("item_id", num("own_ear").alias("own_ear"))


@query("K2_catalogue_order", "SELECT id, level3, base_scope FROM refs_plain ORDER BY level3 DESC NULLS FIRST, id", "refs_plain")
def catalogue_order(d):
    return topk.catalogue_order(d.refs_plain, "level3", "desc").select("id", "level3", "base_scope")


@query(
    "K3_catalogue_page",
    "SELECT id FROM refs_plain ORDER BY base_scope ASC NULLS LAST, level2 ASC NULLS LAST, id LIMIT 20 OFFSET 20",
    "refs_plain",
)
def catalogue_page(d):
    return topk.page(topk.catalogue_order(d.refs_plain), 2).select("id")


@query("K3_newest_files", "SELECT file_id FROM files ORDER BY created_at DESC, file_id DESC LIMIT 10", "files")
def newest(d):
    return topk.newest_files(d.files).select("file_id")


@query(
    "K4_first_lines",
    "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS n FROM lines) WHERE n <= 5",
    "lines",
)
def first_lines(d):
    return topk.first_lines(d.lines, 5).select("item_id")


@query("K5_top_quantity", f"SELECT file_id, item_id, eau, rank FROM {_TOPQ} WHERE rank <= 10", "lines")
def top_quantity(d):
    return topk.top_quantity_lines(d.lines).select("file_id", "item_id", "eau", F.col("rank").cast("bigint").alias("rank"))


@query("F5_export_filter_json", "SELECT item_id FROM lines WHERE eau > 0", "lines")
def filter_json(d):
    return export_filter_json(d.lines, '{"scope": [], "data": ["with_demand"]}').select("item_id")
