"""The given tables seen as bills of material, in Spark and as SQL for the checks.

A file is a range of 1000 order keys, so files grow in number with the data and keep their size. Every frame
is built from whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.scope import grade_of
from partloom.functions.text import reference_text
from partloom.functions.vectors import stand_in_embedding
from partloom.operators.mapping import RAW_COLUMNS
from partloom.plans.process import SideTables
from partloom.session import tune
from partloom.sources.sheets import header_table
from registry import sqlx

PRICE = "decimal(28,10)"


def _dec(name: str, scale: int) -> Column:
    return F.col(name).cast(f"decimal(10,{scale})")


# Header of every raw field in the three sheet layouts (by file); a field missing from a layout has no column.
LAYOUTS: dict[int, dict[str, str]] = {
    0: {
        "raw_item": "ITEM",
        "raw_description": "DESCRIPTION",
        "raw_mpn": "MFG_PARTNO",
        "raw_mfg": "GLOBAL_MFG_NAME",
        "raw_std_cost": "STD_COST",
        "raw_last_purchase_price": "LAST_PURCHASE_PRICE",
        "raw_last_po": "LAST_PO",
        "raw_eau": "EAU",
        "raw_site": "SITE",
        "raw_level3": "LEVEL3_DESC",
    },
    1: {
        "raw_quote_no": "Quote Id",
        "raw_item": "Item Code",
        "raw_description": "Item Description",
        "raw_mpn": "Part Number",
        "raw_mfg": "Manufacturer",
        "raw_std_cost": "Unit Cost",
        "raw_last_purchase_price": "Purchase Price",
        "raw_last_po": "Last Order",
        "raw_eau": "Annual Usage",
        "raw_site": "Location",
        "raw_level1": "Level 1",
        "raw_global_code": " GLOBAL COMM CODE DESC ",
    },
    2: {
        "raw_item": "item no",
        "raw_description": "desc",
        "raw_mpn": "mfr part",
        "raw_std_cost": "unit price",
        "raw_eau": "eau",
    },
}
TARGET_OF = RAW_COLUMNS


def _string_map(entries: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))])


class Domain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _base(self) -> DataFrame:
        """Line items with part and supplier, and the line number."""
        number = F.concat(
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.lpad(F.unix_date(F.col("l_shipdate").cast("date")).cast("string"), 5, "0"),
            F.lpad(F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), 8, "0"),
            F.lpad(F.col("l_suppkey").cast("string"), 10, "0"),
        )
        joined = (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        return joined.withColumn("file_id", F.floor(F.col("l_orderkey") / 1000).cast("bigint")).withColumns(
            {
                "item_id": number,
                "line_no": number.cast("decimal(38,0)"),
                "mpn": F.when(F.col("s_acctbal") < 1000, F.lit(None).cast("string"))
                .when(F.col("p_size") <= 5, F.concat(F.lit("P"), "l_partkey"))
                .otherwise(F.concat(F.lit("M"), "l_partkey")),
                "desc": F.concat("p_brand", F.lit(", "), "p_name", F.lit(" "), "p_type"),
            }
        )

    @cached_property
    def lines(self) -> DataFrame:
        retail = _dec("p_retailprice", 2)
        return self._base.select(
            "file_id",
            "item_id",
            "line_no",
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Q-"), "l_orderkey")).alias("quote_no"),
            F.concat(F.lit("P"), "l_partkey").alias("item"),
            F.col("mpn").alias("mfg_partno"),
            F.col("s_name").alias("mfg_name"),
            F.col("desc").alias("description"),
            F.concat(F.lit("SITE-"), "s_nationkey").alias("site"),
            F.when(~(F.col("l_tax") > 0.06), retail.cast(PRICE)).alias("std_cost"),
            F.when(~(F.col("l_discount") < 0.02), (retail * (1 - _dec("l_discount", 2))).cast(PRICE)).alias(
                "last_purchase_price"
            ),
            F.when(F.col("l_returnflag") == "A", (retail * (1 + _dec("l_tax", 2))).cast(PRICE))
            .when(F.col("l_returnflag") == "N", F.lit(0).cast(PRICE))
            .alias("last_po"),
            F.when(F.col("l_quantity") > 45, F.lit(None).cast("bigint"))
            .when(F.col("l_quantity") > 35, F.lit(0).cast("bigint"))
            .otherwise(F.col("l_quantity").cast("bigint") * 5)
            .alias("eau"),
            F.when(F.col("l_linenumber") == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("commodity"),
            F.when(F.col("l_returnflag") == "A", "In scope")
            .when(F.col("l_returnflag") == "N", " IN SCOPE")
            .when(F.col("l_linestatus") == "F", "Requires Review")
            .alias("scope"),
            (F.col("file_id") % 2 == 1).alias("auto_mode"),
            (F.col("file_id") % 3 != 0).alias("demand_lookup"),
            grade_of(F.col("file_id") % 2 == 1).alias("grade"),
        )

    @cached_property
    def refs_plain(self) -> DataFrame:
        """Catalogue rows: a pair of type and name each; names repeat, so lookups must choose."""
        size = F.length("p_type") + F.length("p_name")
        shape = F.length("p_name") % 3
        return (
            self.table("part")
            .groupBy("p_type", "p_name")
            .agg(F.min("p_partkey").alias("id"), F.max("p_partkey").alias("last_id"), F.min("p_brand").alias("keyword"), F.max("p_brand").alias("mfr"))
            .select(
                "id",
                F.element_at(F.split("p_name", " "), 2).alias("global_code"),
                F.col("p_type").alias("level1"),
                F.element_at(F.split("p_name", " "), 2).alias("level2"),
                F.col("p_name").alias("level3"),
                F.when(F.length("p_type") % 2 == 0, F.concat(F.lit("PCB, "), "p_name")).alias("level3_expanded"),
                F.when(size % 4 == 0, "In Scope")
                .when(size % 4 == 1, " in scope ")
                .when(size % 4 == 2, "Out of Scope")
                .alias("base_scope"),
                F.when(shape == 0, "In Scope").when(shape == 1, "out of scope").alias("auto_scope"),
                "keyword",
                "mfr",
                F.concat(F.lit("M"), "id", F.lit(",M"), "last_id", F.lit(",X1,X2")).alias("typical_mpns"),
            )
        )

    @cached_property
    def refs(self) -> DataFrame:
        return self.refs_plain.withColumn("embedding", stand_in_embedding(reference_text()))

    @cached_property
    def crosses(self) -> DataFrame:
        """A row per (part, supplier) pair that was ever delivered."""
        line = self.table("lineitem").groupBy("l_partkey", "l_suppkey").agg(
            F.min("l_extendedprice").alias("price"),
            F.max("l_tax").alias("tax"),
            F.max("l_discount").alias("discount"),
            F.max("l_linestatus").alias("ls"),
            F.min("l_returnflag").alias("rf"),
        )
        part = self.table("part").select("p_partkey", "p_size")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.when(F.col("tax") >= 0.02, F.concat(F.when(F.col("p_size") > 25, "M").otherwise("X"), "l_partkey")).alias(
                "cross_ref_mpn"
            ),
            F.concat(F.lit("S"), "l_suppkey").alias("supplier_pn"),
            F.when(F.col("discount") < 0.03, F.lit(None).cast("string"))
            .when(F.col("discount") < 0.05, "  ")
            .otherwise(F.concat(F.lit("H"), "l_partkey", F.lit("-"), "l_suppkey"))
            .alias("house_mpn"),
            F.when(F.col("tax") < 0.07, F.col("price").cast(PRICE)).alias("house_cost"),
            F.concat(F.lit("MFG"), (F.col("l_suppkey") % 5)).alias("cross_ref_mfg"),
            F.when(F.col("ls") == "O", "AUTO").otherwise("COMMERCIAL").alias("component_grade"),
            F.when(F.col("rf") == "A", "ACTIVE").when(F.col("rf") == "N", " active ").otherwise("OBSOLETE").alias("status"),
        )

    @cached_property
    def quotes(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        real = (F.col("o_orderpriority") == "1-URGENT") & (F.col("l_quantity") > 45)
        return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.concat(F.when(real, "P").otherwise("Z"), "l_partkey").alias("item"),
            F.when(F.col("l_partkey") % 3 != 0, F.col("o_orderdate")).alias("log_date"),
            F.concat(F.lit("SQ-"), "o_orderkey").alias("quote_number"),
            F.concat(F.lit("QM-"), "l_suppkey").alias("quote_mpn"),
        )

    @cached_property
    def aml(self) -> DataFrame:
        retail = _dec("p_retailprice", 2)
        return self.table("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("item"),
            F.when(F.col("p_size") > 10, (F.col("p_size") * 10).cast("bigint")).alias("total_demand"),
            F.when(F.col("p_size") <= 40, (retail * F.lit("0.9").cast("decimal(2,1)")).cast(PRICE)).alias("min_price"),
        )

    @cached_property
    def manufacturers(self) -> DataFrame:
        """Aliases of the suppliers with money; the others keep their name."""
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("id"),
                F.when(F.col("s_acctbal") > 3000, F.col("s_name")).otherwise(F.lower("s_name")).alias("original_name"),
                F.col("n_name").alias("standardized_name"),
            )
        )

    @cached_property
    def files(self) -> DataFrame:
        file_id = F.floor(F.col("o_orderkey") / 1000).cast("bigint")
        key = F.col("file_id")
        return (
            self.table("orders")
            .groupBy(file_id.alias("file_id"))
            .agg(F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))
            .select(
                "file_id",
                "created_at",
                "updated_at",
                F.when(key % 4 == 0, "pending").when(key % 4 == 1, "failed").otherwise("completed").alias("status"),
                (key % 3).cast("int").alias("layout"),
                (key % 2 == 1).alias("auto_mode"),
                (key % 3 != 0).alias("demand_lookup"),
                F.when(key % 4 != 0, (key % 4).cast("int")).alias("volume_multiplier"),
                (key % 10).alias("user_id"),
            )
        )

    @cached_property
    def mapped_files(self) -> DataFrame:
        """Files with their headers and the mapping given by hand for their layout."""
        mapping, headers = None, None
        for layout, fields in LAYOUTS.items():
            test = F.col("layout") == layout
            m = _string_map({TARGET_OF[raw]: F.lit(header) for raw, header in fields.items()})
            h = F.array(*[F.lit(header) for header in fields.values()])
            mapping = F.when(test, m) if mapping is None else mapping.when(test, m)
            headers = F.when(test, h) if headers is None else headers.when(test, h)
        return self.files.withColumns({"mapping": mapping, "headers": headers})

    @cached_property
    def raw(self) -> DataFrame:
        """Raw texts of every line before they are laid out in a sheet."""
        n = F.col("l_linenumber")
        price = _dec("p_retailprice", 2).cast("decimal(18,2)").cast("string")
        paid = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
        quantity = F.col("l_quantity").cast("bigint").cast("string")
        missing = (n == 6) & (F.col("mpn").isNotNull() | (F.col("file_id") % 5 == 4))
        return self._base.select(
            "file_id",
            "item_id",
            "line_no",
            F.concat(F.lit("Q-"), "l_orderkey").alias("raw_quote_no"),
            F.when(missing, "").otherwise(F.concat(F.lit("P"), "l_partkey")).alias("raw_item"),
            F.col("mpn").alias("raw_mpn"),
            F.col("s_name").alias("raw_mfg"),
            F.when(n == 5, "  ").otherwise(F.col("desc")).alias("raw_description"),
            F.concat(F.lit("SITE-"), "s_nationkey").alias("raw_site"),
            F.when(n == 1, F.concat(F.lit("$"), price))
            .when(n == 2, F.concat(price, F.lit(" USD")))
            .when(n == 3, " ")
            .when(n == 5, F.regexp_replace(price, r"\.", ","))
            .when(n != 4, price)
            .alias("raw_std_cost"),
            F.when(n == 7, F.concat(F.lit("-"), paid)).otherwise(F.concat(F.lit("€ "), paid)).alias("raw_last_purchase_price"),
            F.when(n == 2, "n/a").when(n == 3, ".5").when(n == 4, "1.2.3").when(n == 6, "0.00035").otherwise(F.lit("7.")).alias("raw_last_po"),
            F.when(n == 1, F.concat(quantity, F.lit(" pcs")))
            .when(n == 2, "1,000")
            .when(n == 3, "")
            .when(n == 4, "abc")
            .when(n == 5, "12.9")
            .otherwise(F.concat(F.lit(" "), quantity))
            .alias("raw_eau"),
            F.col("p_type").alias("raw_level1"),
            F.when(n == 1, F.upper("p_name"))
            .when(n == 2, F.concat(F.lit("  "), "p_name"))
            .when(n == 7, "")
            .otherwise(F.col("p_name"))
            .alias("raw_level3"),
            F.element_at(F.split("p_name", " "), 2).alias("raw_global_code"),
        )

    @cached_property
    def sheets(self) -> DataFrame:
        """Sheet rows: the cells in the column order of the file's layout."""
        layout = F.col("file_id") % 3
        values = None
        for number, fields in LAYOUTS.items():
            v = F.array(*[F.col(raw) for raw in fields])
            values = F.when(layout == number, v) if values is None else values.when(layout == number, v)
        return self.raw.select("file_id", "item_id", "line_no", values.alias("values"))

    @cached_property
    def file_headers(self) -> DataFrame:
        return self.mapped_files.select("file_id", "headers")

    @cached_property
    def headers(self) -> DataFrame:
        """Headers of every file by position."""
        return header_table(self.file_headers)

    @cached_property
    def logins(self) -> DataFrame:
        """Events as logins (signup), logouts (error) and other activity."""
        kind = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "error", "logout").otherwise("other")
        return self.table("events").select("event_id", "user_id", "ts", kind.alias("kind"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("events").groupBy("user_id").agg(F.min("ts").alias("last_sign_in_at")).withColumn(
            "admin", F.col("user_id") % 5 == 0
        )

    @cached_property
    def centroids(self) -> DataFrame:
        """One catalogue vector per label: the mean of its vectors."""
        dims = self.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
        mean = dims.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        ordered = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
        return ordered.select(F.col("label").cast("bigint").alias("ref_id"), F.transform("v", lambda e: e["x"]).alias("vec"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))

    @cached_property
    def responses(self) -> DataFrame:
        """A model answer per line: free text with a decision, in three shapes, some unreadable; some came after another."""
        key = F.col("l_partkey")
        level = F.when(F.col("qty") > 40, "high").when(F.col("qty") > 20, "medium").otherwise("low")
        body = F.concat(
            F.lit('{"should_correct": '), F.when(F.col("qty") % 2 == 0, "true").otherwise("false"),
            F.lit(', "confidence_level": "'), level,
            F.lit('", "current_assignment_correct": false, "recommended_commodity": "C'), key % 7,
            F.lit('", "recommended_scope": "In scope", "reasoning": "r", "evidence": "e'), key, F.lit('"}'),
        )
        shape = F.col("qty").cast("bigint") % 4
        text = (
            F.when(shape == 0, F.concat(F.lit("Analysis.\n```json\n"), body, F.lit("\n```\nend")))
            .when(shape == 1, F.concat(F.lit("plain "), body, F.lit(" tail")))
            .when(shape == 2, F.concat(F.lit("text ```json "), body, F.lit(" ```")))
            .otherwise(F.concat(F.lit("no decision for "), key))
        )
        answered = self._base.select("item_id", "l_partkey", F.col("l_quantity").alias("qty")).select("item_id", "qty", text.alias("response_text"))
        last = F.struct("response_text", F.lit(2).alias("response_no"))
        superseded = F.struct(F.lit('{"should_correct": true, "confidence_level": "high"}').alias("response_text"), F.lit(1).alias("response_no"))
        of_line = F.when(F.col("qty") % 3 == 0, F.array(last, superseded)).otherwise(F.array(last))
        return answered.select("item_id", F.explode(of_line).alias("response")).select("item_id", "response.*")

    @cached_property
    def sides(self) -> SideTables:
        return SideTables(self.refs, self.manufacturers, self.crosses, self.quotes, self.aml)


# --- the same frames in SQL ---------------------------------------------------------------------------

_BASE = """
SELECT *, l_orderkey // 1000 AS file_id,
  concat(l_orderkey, l_linenumber,
    lpad(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR), 5, '0'),
    lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 8, '0'),
    lpad(CAST(l_suppkey AS VARCHAR), 10, '0')) AS item_id,
  CAST(concat(l_orderkey, l_linenumber,
    lpad(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR), 5, '0'),
    lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 8, '0'),
    lpad(CAST(l_suppkey AS VARCHAR), 10, '0')) AS DECIMAL(38,0)) AS line_no,
  CASE WHEN s_acctbal < 1000 THEN NULL WHEN p_size <= 5 THEN 'P' || l_partkey ELSE 'M' || l_partkey END AS mpn,
  p_brand || ', ' || p_name || ' ' || p_type AS descr,
  CAST(p_retailprice AS DECIMAL(10,2)) AS retail
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "base": ((), _BASE),
    "lines": (
        ("base",),
        """
SELECT file_id, item_id, line_no,
  CASE WHEN l_returnflag = 'R' THEN 'Q-' || l_orderkey END AS quote_no,
  'P' || l_partkey AS item, mpn AS mfg_partno, s_name AS mfg_name, descr AS description,
  'SITE-' || s_nationkey AS site,
  CASE WHEN l_tax > 0.06::DOUBLE THEN NULL ELSE CAST(retail AS DECIMAL(28,10)) END AS std_cost,
  CASE WHEN l_discount < 0.02::DOUBLE THEN NULL
    ELSE CAST(retail * (1 - CAST(l_discount AS DECIMAL(10,2))) AS DECIMAL(28,10)) END AS last_purchase_price,
  CASE l_returnflag WHEN 'A' THEN CAST(retail * (1 + CAST(l_tax AS DECIMAL(10,2))) AS DECIMAL(28,10))
    WHEN 'N' THEN CAST(0 AS DECIMAL(28,10)) END AS last_po,
  CASE WHEN l_quantity > 45 THEN NULL WHEN l_quantity > 35 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 5 END AS eau,
  CASE WHEN l_linenumber = 1 THEN upper(p_name) ELSE p_name END AS commodity,
  CASE WHEN l_returnflag = 'A' THEN 'In scope' WHEN l_returnflag = 'N' THEN ' IN SCOPE'
    WHEN l_linestatus = 'F' THEN 'Requires Review' END AS scope,
  file_id % 2 = 1 AS auto_mode, file_id % 3 <> 0 AS demand_lookup,
  CASE WHEN file_id % 2 = 1 THEN 'AUTO' ELSE 'COMMERCIAL' END AS grade
FROM base
""",
    ),
    "refs_plain": (
        (),
        """
SELECT min(p_partkey) AS id, split_part(p_name, ' ', 2) AS global_code, p_type AS level1,
  split_part(p_name, ' ', 2) AS level2, p_name AS level3,
  CASE WHEN length(p_type) % 2 = 0 THEN 'PCB, ' || p_name END AS level3_expanded,
  CASE (length(p_type) + length(p_name)) % 4 WHEN 0 THEN 'In Scope' WHEN 1 THEN ' in scope ' WHEN 2 THEN 'Out of Scope' END AS base_scope,
  CASE length(p_name) % 3 WHEN 0 THEN 'In Scope' WHEN 1 THEN 'out of scope' END AS auto_scope,
  min(p_brand) AS keyword, max(p_brand) AS mfr,
  'M' || min(p_partkey) || ',M' || max(p_partkey) || ',X1,X2' AS typical_mpns
FROM part GROUP BY p_type, p_name
""",
    ),
    "refs": (("refs_plain",), f"SELECT *, {sqlx.stand_in(sqlx.ref_text())} AS embedding FROM refs_plain"),
    "ref_by_level3": (("refs_plain",), "SELECT lower(level3) AS k, arg_min({'id': id, 'level1': level1, 'base_scope': base_scope, 'auto_scope': auto_scope}, id) AS r FROM refs_plain GROUP BY 1"),
    "ref_by_code": (("refs_plain",), "SELECT lower(global_code) AS k, arg_min({'id': id, 'level1': level1, 'base_scope': base_scope, 'auto_scope': auto_scope}, id) AS r FROM refs_plain GROUP BY 1"),
    "ref_last": (("refs_plain",), "SELECT lower(level3) AS k, arg_max({'id': id, 'level1': level1, 'base_scope': coalesce(base_scope, ''), 'auto_scope': auto_scope}, id) AS r FROM refs_plain GROUP BY 1"),
    "crosses": (
        (),
        """
SELECT CASE WHEN tax >= 0.02::DOUBLE THEN (CASE WHEN p_size > 25 THEN 'M' ELSE 'X' END) || l_partkey END AS cross_ref_mpn,
  'S' || l_suppkey AS supplier_pn,
  CASE WHEN discount < 0.03::DOUBLE THEN NULL WHEN discount < 0.05::DOUBLE THEN '  ' ELSE 'H' || l_partkey || '-' || l_suppkey END AS house_mpn,
  CASE WHEN tax < 0.07::DOUBLE THEN CAST(price AS DECIMAL(28,10)) END AS house_cost,
  'MFG' || (l_suppkey % 5) AS cross_ref_mfg,
  CASE WHEN ls = 'O' THEN 'AUTO' ELSE 'COMMERCIAL' END AS component_grade,
  CASE rf WHEN 'A' THEN 'ACTIVE' WHEN 'N' THEN ' active ' ELSE 'OBSOLETE' END AS status
FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS price, max(l_tax) AS tax, max(l_discount) AS discount,
  max(l_linestatus) AS ls, min(l_returnflag) AS rf FROM lineitem GROUP BY 1, 2) JOIN part ON l_partkey = p_partkey
""",
    ),
    "cross_keys": (
        ("crosses",),
        """
SELECT cross_ref_mpn, component_grade, true AS has_cross,
  bool_or(status = 'ACTIVE' AND house_mpn IS NOT NULL) AS active_cross,
  max(CASE WHEN upper(trim(status)) = 'ACTIVE' THEN house_mpn END) AS cross_mpn
FROM crosses WHERE cross_ref_mpn IS NOT NULL GROUP BY 1, 2
""",
    ),
    "quotes": (
        (),
        """
SELECT (CASE WHEN o_orderpriority = '1-URGENT' AND l_quantity > 45 THEN 'P' ELSE 'Z' END) || l_partkey AS item,
  CASE WHEN l_partkey % 3 <> 0 THEN o_orderdate END AS log_date, 'SQ-' || o_orderkey AS quote_number, 'QM-' || l_suppkey AS quote_mpn
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""",
    ),
    "last_quotes": (
        ("quotes",),
        "SELECT item, log_date, quote_number, quote_mpn FROM quotes WHERE item IS NOT NULL QUALIFY row_number() "
        "OVER (PARTITION BY item ORDER BY log_date DESC, quote_number DESC, quote_mpn DESC) = 1",
    ),
    "aml": (
        (),
        """
SELECT 'P' || p_partkey AS item, CASE WHEN p_size > 10 THEN CAST(p_size * 10 AS BIGINT) END AS total_demand,
  CASE WHEN p_size <= 40 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.9 AS DECIMAL(28,10)) END AS min_price
FROM part
""",
    ),
    "manufacturers": (
        (),
        "SELECT s_suppkey AS id, CASE WHEN s_acctbal > 3000 THEN s_name ELSE lower(s_name) END AS original_name, "
        "n_name AS standardized_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "files": (
        (),
        """
SELECT o_orderkey // 1000 AS file_id, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at,
  CASE file_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
  CAST(file_id % 3 AS INTEGER) AS layout, file_id % 2 = 1 AS auto_mode, file_id % 3 <> 0 AS demand_lookup,
  CASE WHEN file_id % 4 <> 0 THEN CAST(file_id % 4 AS INTEGER) END AS volume_multiplier, file_id % 10 AS user_id
FROM orders GROUP BY 1
""",
    ),
    "raw_all": (
        ("base",),
        """
SELECT file_id, item_id, line_no, 'Q-' || l_orderkey AS raw_quote_no,
  CASE WHEN l_linenumber = 6 AND (mpn IS NOT NULL OR file_id % 5 = 4) THEN '' ELSE 'P' || l_partkey END AS raw_item,
  mpn AS raw_mpn, s_name AS raw_mfg, CASE WHEN l_linenumber = 5 THEN '  ' ELSE descr END AS raw_description,
  'SITE-' || s_nationkey AS raw_site,
  CASE l_linenumber WHEN 1 THEN '$' || retail WHEN 2 THEN retail || ' USD' WHEN 3 THEN ' ' WHEN 4 THEN NULL
    WHEN 5 THEN replace(CAST(retail AS VARCHAR), '.', ',') ELSE CAST(retail AS VARCHAR) END AS raw_std_cost,
  (CASE WHEN l_linenumber = 7 THEN '-' ELSE '€ ' END) || CAST(l_extendedprice AS DECIMAL(18,2)) AS raw_last_purchase_price,
  CASE l_linenumber WHEN 2 THEN 'n/a' WHEN 3 THEN '.5' WHEN 4 THEN '1.2.3' WHEN 6 THEN '0.00035' ELSE '7.' END AS raw_last_po,
  CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS BIGINT) || ' pcs' WHEN 2 THEN '1,000' WHEN 3 THEN '' WHEN 4 THEN 'abc'
    WHEN 5 THEN '12.9' ELSE ' ' || CAST(l_quantity AS BIGINT) END AS raw_eau,
  p_type AS raw_level1,
  CASE l_linenumber WHEN 1 THEN upper(p_name) WHEN 2 THEN '  ' || p_name WHEN 7 THEN '' ELSE p_name END AS raw_level3,
  split_part(p_name, ' ', 2) AS raw_global_code
FROM base
""",
    ),
    "logins": (
        (),
        "SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'logout' "
        "ELSE 'other' END AS kind FROM events",
    ),
    "sessions": (
        ("logins",),
        """
SELECT event_id AS session_id, user_id, ts AS started_at, nts AS ended_at,
  CASE WHEN nk = 'logout' THEN CAST(floor(epoch_us(nts) / 1000000.0 - epoch_us(ts) / 1000000.0) AS BIGINT) END AS duration_seconds,
  CASE nk WHEN 'logout' THEN 'manual' WHEN 'login' THEN 'orphaned' END AS sign_out_reason
FROM (SELECT *, lead(ts) OVER w AS nts, lead(kind) OVER w AS nk FROM logins WHERE kind <> 'other'
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE kind = 'login'
""",
    ),
    "users": ((), "SELECT user_id, min(ts) AS last_sign_in_at, user_id % 5 = 0 AS admin FROM events GROUP BY 1"),
    "centroids": (
        (),
        """
SELECT CAST(label AS BIGINT) AS ref_id, list(x ORDER BY pos) AS vec
FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2)
GROUP BY 1
""",
    ),
    "ranked": (
        ("centroids",),
        f"""
SELECT vec_id AS key, ref_id, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ref_id) AS rank
FROM (SELECT vec_id, ref_id, round({sqlx.cosine('e.embedding', 'c.vec')}, 12) AS sim FROM embeddings e CROSS JOIN centroids c)
""",
    ),
    "responses": (
        ("base",),
        """
SELECT item_id, CASE CAST(l_quantity AS BIGINT) % 4
  WHEN 0 THEN 'Analysis.' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'end'
  WHEN 1 THEN 'plain ' || body || ' tail' WHEN 2 THEN 'text ```json ' || body || ' ```'
  ELSE 'no decision for ' || l_partkey END AS response_text, 2 AS response_no
FROM (SELECT *, '{"should_correct": ' || (CASE WHEN l_quantity % 2 = 0 THEN 'true' ELSE 'false' END) ||
  ', "confidence_level": "' || (CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'medium' ELSE 'low' END) ||
  '", "current_assignment_correct": false, "recommended_commodity": "C' || (l_partkey % 7) ||
  '", "recommended_scope": "In scope", "reasoning": "r", "evidence": "e' || l_partkey || '"}' AS body FROM base)
UNION ALL SELECT item_id, '{"should_correct": true, "confidence_level": "high"}', 1 FROM base WHERE l_quantity % 3 = 0
""",
    ),
    "decisions": (
        ("responses",),
        r"""
SELECT item_id,
  CASE WHEN j = '' THEN false ELSE CAST(json_extract_string(j, '$.should_correct') AS BOOLEAN) END AS should_correct,
  CASE WHEN j = '' THEN 'low' ELSE json_extract_string(j, '$.confidence_level') END AS confidence_level,
  CASE WHEN j = '' THEN true ELSE CAST(json_extract_string(j, '$.current_assignment_correct') AS BOOLEAN) END AS current_assignment_correct,
  CASE WHEN j = '' THEN NULL ELSE json_extract_string(j, '$.recommended_commodity') END AS recommended_commodity,
  CASE WHEN j = '' THEN NULL ELSE json_extract_string(j, '$.recommended_scope') END AS recommended_scope
FROM (SELECT item_id, CASE WHEN f <> '' THEN f ELSE regexp_extract(response_text, '(?s).*(\{.*\})', 1) END AS j
  FROM (SELECT *, regexp_extract(response_text, '(?s)```json\s*(\{.*?\})\s*```', 1) AS f FROM responses QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY response_no DESC) = 1))
""",
    ),
}

_EAR = sqlx.ear("demand", "min_price")


def enriched_sql(lines: str) -> str:
    """Enrichment of a line frame of that name."""
    return f"""
SELECT *, CASE WHEN ear IS NULL THEN 'Insufficient data' WHEN ear >= 100000 THEN 'Compliant' ELSE 'Non-Compliant' END AS ear_status,
  CASE WHEN previously_quoted = 'YES' THEN 'In scope' ELSE scope END AS final_scope,
  ({sqlx.norm_scope('scope')} = 'In scope' OR item_quoted) AS inside, coalesce(ear >= 100000, false) AS met
FROM (SELECT *, {_EAR} AS ear,
    ((NOT coalesce(eau > 0, false)) AND coalesce(demand > 0, false)) OR
    ((coalesce(eau > 0, false) OR coalesce(demand > 0, false)) AND {sqlx.lowest_price()} IS NULL AND coalesce(min_price > 0, false)) AS ear_fallback
  FROM (SELECT l.*, CASE WHEN row_number() OVER (PARTITION BY l.file_id, l.item ORDER BY l.line_no) = 1 THEN 'Unique' ELSE 'AML' END AS duplication_flag,
      coalesce(c.has_cross, false) AS has_cross, coalesce(c.active_cross, false) AS active_cross, c.cross_mpn,
      q.item IS NOT NULL AS item_quoted,
      CASE WHEN q.item IS NOT NULL AND l.item IS DISTINCT FROM l.mfg_partno THEN 'YES' ELSE 'NO' END AS previously_quoted,
      CASE WHEN l.item IS DISTINCT FROM l.mfg_partno THEN q.log_date END AS quote_date,
      CASE WHEN l.item IS DISTINCT FROM l.mfg_partno THEN q.quote_number END AS previous_quote_number,
      CASE WHEN l.item IS DISTINCT FROM l.mfg_partno THEN q.quote_mpn END AS quoted_mpn,
      CASE WHEN l.demand_lookup THEN a.total_demand END AS demand, a.min_price
    FROM {lines} l LEFT JOIN last_quotes q ON l.item = q.item LEFT JOIN aml a ON trim(l.item) = a.item
      LEFT JOIN cross_keys c ON l.mfg_partno = c.cross_ref_mpn AND l.grade = c.component_grade))
"""


CTES["enriched"] = (("lines", "last_quotes", "cross_keys", "aml"), enriched_sql("lines"))


def _raw_of_layout() -> str:
    """Raw fields as their file's layout carries them."""
    columns = []
    for raw in TARGET_OF:
        if raw == "raw_level2":
            columns.append("CAST(NULL AS VARCHAR) AS raw_level2")
            continue
        layouts = [str(n) for n, fields in LAYOUTS.items() if raw in fields]
        columns.append(f"CASE WHEN file_id % 3 IN ({', '.join(layouts)}) THEN {raw} END AS {raw}")
    return f"SELECT file_id, item_id, line_no, {', '.join(columns)} FROM raw_all"


CTES["raw"] = (("raw_all",), _raw_of_layout())
CTES["standard"] = (
    ("raw", "files", "manufacturers"),
    f"""
SELECT r.*, f.auto_mode, f.demand_lookup, CASE WHEN f.auto_mode THEN 'AUTO' ELSE 'COMMERCIAL' END AS grade,
  CASE f.layout WHEN 0 THEN 'level3' WHEN 1 THEN 'global_code' ELSE 'similarity' END AS path,
  CASE WHEN {sqlx.blank('raw_item')} AND {sqlx.present('raw_mpn')} THEN raw_mpn ELSE raw_item END AS item,
  raw_quote_no AS quote_no, raw_mpn AS mfg_partno, coalesce(m.standardized_name, raw_mfg) AS mfg_name,
  coalesce({sqlx.presence('raw_description')}, {sqlx.presence('raw_mpn')}, 'No description provided') AS description,
  raw_site AS site, {sqlx.money('raw_std_cost')} AS std_cost, {sqlx.money('raw_last_purchase_price')} AS last_purchase_price,
  {sqlx.money('raw_last_po')} AS last_po,
  ({sqlx.quantity('raw_eau')}) * (CASE WHEN f.volume_multiplier > 1 THEN f.volume_multiplier ELSE 1 END) AS eau
FROM raw r JOIN files f USING (file_id) LEFT JOIN manufacturers m ON r.raw_mfg = m.original_name
""",
)
CTES["bad_files"] = (("standard",), f"SELECT DISTINCT file_id FROM standard WHERE {sqlx.blank('item')}")
CTES["existing"] = (
    ("standard", "ref_by_level3", "ref_by_code", "cross_keys"),
    f"""
SELECT s.*, coalesce(named, 'Unknown') AS commodity,
  CASE WHEN coalesce(c.has_cross, false) THEN 'In scope' WHEN named IS NULL THEN 'Out of scope'
    ELSE {sqlx.resolve("(CASE WHEN path = 'level3' THEN a.r.base_scope ELSE b.r.base_scope END)", "(CASE WHEN path = 'level3' THEN a.r.auto_scope ELSE b.r.auto_scope END)", 'auto_mode')} END AS scope,
  named IS NOT NULL AS remappable, coalesce(c.has_cross, false) AS has_cross
FROM (SELECT *, {sqlx.presence(sqlx.strip("(CASE WHEN path = 'level3' THEN raw_level3 ELSE raw_global_code END)"))} AS named
  FROM standard WHERE path <> 'similarity') s
LEFT JOIN ref_by_level3 a ON lower(s.named) = a.k LEFT JOIN ref_by_code b ON lower(s.named) = b.k
LEFT JOIN cross_keys c ON s.mfg_partno = c.cross_ref_mpn AND s.grade = c.component_grade
""",
)
_TEXT = sqlx.line_text("raw_item", "raw_mpn", "raw_description", "raw_mfg", "raw_global_code", ("raw_level1", "raw_level2", "raw_level3"))
CTES["texted"] = (("standard",), f"SELECT *, {_TEXT} AS txt FROM standard WHERE path = 'similarity'")
CTES["nearest_text"] = (
    ("texted", "refs"),
    f"""
SELECT txt, arg_min(level3, (-sim, id)) AS found FROM (
  SELECT t.txt, r.level3, r.id, round(list_inner_product(t.v, r.v) / (t.n * r.n), 12) AS sim
  FROM (SELECT txt, CAST({sqlx.stand_in('txt')} AS DOUBLE[]) AS v, sqrt(list_inner_product(v, v)) AS n
      FROM (SELECT DISTINCT {sqlx.strip('txt')} AS txt FROM texted WHERE txt <> '')) t
  CROSS JOIN (SELECT id, level3, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(v, v)) AS n FROM refs) r)
GROUP BY txt
""",
)
_LITTLE = r"(length(txt) < 10 OR len(list_filter(regexp_split_to_array(txt, '[,;\s\-_|/]+'), lambda w: length(w) >= 3)) < 2)"
CTES["searched"] = (
    ("texted", "nearest_text", "ref_by_level3", "cross_keys"),
    f"""
SELECT t.*, CASE WHEN t.txt = '' THEN 'Unknown' WHEN {_LITTLE.replace('txt', 't.txt')} THEN 'Insufficient Context'
    ELSE coalesce(found, 'Unknown') END AS commodity,
  CASE WHEN coalesce(c.has_cross, false) THEN 'In scope' WHEN t.txt <> '' AND {_LITTLE.replace('txt', 't.txt')} THEN 'Requires Review'
    WHEN found IS NOT NULL THEN {sqlx.resolve('a.r.base_scope', 'a.r.auto_scope', 'auto_mode')} ELSE 'Out of scope' END AS scope,
  true AS remappable, coalesce(c.has_cross, false) AS has_cross
FROM texted t LEFT JOIN nearest_text n ON {sqlx.strip('t.txt')} = n.txt LEFT JOIN ref_by_level3 a ON lower({sqlx.strip('n.found')}) = a.k
LEFT JOIN cross_keys c ON t.mfg_partno = c.cross_ref_mpn AND t.grade = c.component_grade
""",
)

_KEPT = (
    "file_id, item_id, line_no, quote_no, item, mfg_partno, mfg_name, description, site, std_cost, "
    "last_purchase_price, last_po, eau, commodity, scope, auto_mode, demand_lookup, grade"
)
CTES["processed"] = (
    ("existing", "searched", "bad_files"),
    f"SELECT * FROM (SELECT {_KEPT} FROM existing UNION ALL SELECT {_KEPT} FROM searched) "
    "WHERE file_id NOT IN (SELECT file_id FROM bad_files)",
)
CTES["processed_enriched"] = (("processed", "last_quotes", "cross_keys", "aml"), enriched_sql("processed"))


def sql(body: str, *names: str) -> str:
    """``body`` preceded by the frames it needs, in dependency order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order) + "\n" + body
