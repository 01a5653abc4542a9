"""SQL texts of the domain's scalar rules, for the checking queries only."""

from __future__ import annotations

from partloom.functions import rules

_SPACE = r"[\t\n\x0B\f\r ]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def blank(c: str) -> str:
    return rf"({c} IS NULL OR regexp_full_match({c}, '[\s\x0B\x{{85}}\p{{Z}}]*'))"


def present(c: str) -> str:
    return rf"({c} IS NOT NULL AND NOT regexp_full_match({c}, '[\s\x0B\x{{85}}\p{{Z}}]*'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"


def presence(c: str) -> str:
    return f"CASE WHEN {present(c)} THEN {c} END"


def squeeze(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[\s\x0B]+', '', 'g')"


def norm_scope(c: str) -> str:
    return f"CASE WHEN lower({strip(c)}) = 'in scope' THEN 'In scope' ELSE 'Out of scope' END"


def resolve(base: str, auto: str, auto_mode: str) -> str:
    return norm_scope(f"(CASE WHEN {auto_mode} AND {present(auto)} THEN {auto} ELSE {base} END)")


def canonical(c: str) -> str:
    return (
        f"CASE lower({strip(c)}) WHEN 'in scope' THEN 'In Scope' WHEN 'out of scope' THEN 'Out of Scope' ELSE {c} END"
    )


def money(c: str) -> str:
    head = rf"regexp_extract(regexp_replace({c}, '[^0-9.\-]', '', 'g'), '^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)')"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {head} = '' THEN CAST(0 AS DECIMAL(28,10)) "
        f"ELSE TRY_CAST({head} AS DECIMAL(28,10)) END"
    )


def quantity(c: str) -> str:
    head = rf"regexp_extract({strip(c)}, '^[+-]?[0-9]+')"
    return f"CASE WHEN {blank(c)} THEN NULL WHEN {head} = '' THEN 0 ELSE TRY_CAST({head} AS BIGINT) END"


def lowest_price(p: str = "") -> str:
    cols = [f"CASE WHEN {p}{c} > 0 THEN {p}{c} END" for c in ("std_cost", "last_purchase_price", "last_po")]
    return f"least({', '.join(cols)})"


def ear(demand: str, price: str, p: str = "") -> str:
    qty = f"CASE WHEN {p}eau > 0 THEN {p}eau WHEN {demand} > 0 THEN {demand} END"
    val = f"coalesce({lowest_price(p)}, CASE WHEN {price} > 0 THEN {price} END)"
    return f"CAST(round(CAST(({qty}) AS DECIMAL(18,0)) * ({val}), 2) AS DECIMAL(38,2))"


def expand(c: str) -> str:
    """Rewrites without the rules that need a look-ahead, which this regex engine lacks."""
    out = c
    for kind, body, text in rules.DESCRIPTION_REWRITES:
        if kind == "bare":
            continue
        if kind == "plain":
            pattern, new = body, text
        elif kind == "word":
            pattern, new = rf"(?i)\b{body}\b", text
        else:
            # The word border must be a Unicode one; taking the next character along needs two rounds.
            pattern, new = rf"(?im)(^|,\s*){body}($|[^\p{{L}}\p{{M}}\p{{N}}_])", rf"\1{text}\2"
            out = f"regexp_replace({out}, {q(pattern)}, {q(new)}, 'g')"
        out = f"regexp_replace({out}, {q(pattern)}, {q(new)}, 'g')"
    return f"CASE WHEN {blank(c)} THEN '' ELSE {strip(out)} END"


def code_name(c: str, hyphen: bool = True) -> str:
    kept = r"[^A-Za-z0-9\s\x0B,\-]" if hyphen else r"[^A-Za-z0-9\s\x0B,]"
    return rf"upper(regexp_replace(regexp_replace({c}, '{kept}', '', 'g'), '[\s\x0B]+', '_', 'g'))"


def labelled(label: str, c: str) -> str:
    return f"CASE WHEN {present(c)} THEN '{label}: ' || {c} END"


def nonempty(label: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '{label}: ' || {c} END"


def line_text(item: str, mpn: str, desc: str, mfg: str, code: str | None = None, levels: tuple = ()) -> str:
    item, mpn = strip(item), strip(mpn)
    name = f"coalesce({presence(item)}, {mpn})"
    parts = [
        f"CASE WHEN {present(name)} THEN 'Product: ' || {code_name(name)} END",
        f"CASE WHEN {present(desc)} THEN 'Description: ' || {expand(strip(desc))} END",
        labelled("Manufacturer", strip(mfg)),
        labelled("MPN", mpn),
    ]
    if code:
        parts.append(labelled("Global Code", strip(code)))
    if levels:
        path = f"concat_ws(' > ', {', '.join(presence(strip(x)) for x in levels)})"
        parts.append(nonempty("Category Hierarchy", path))
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def stored_text(p: str = "") -> str:
    name = f"coalesce({presence(p + 'item')}, {p}mfg_partno)"
    return (
        "concat_ws(chr(10), "
        + ", ".join(
            [
                f"CASE WHEN {present(name)} THEN 'Product: ' || {code_name(name)} END",
                f"CASE WHEN {present(p + 'description')} THEN 'Description: ' || {expand(p + 'description')} END",
                labelled("Manufacturer", p + "mfg_name"),
                labelled("MPN", p + "mfg_partno"),
            ]
        )
        + ")"
    )


def ref_text(p: str = "") -> str:
    path = f"concat_ws(' > ', {presence(p + 'level1')}, {presence(p + 'level2')})"
    return (
        "concat_ws(chr(10), "
        + ", ".join(
            [
                f"CASE WHEN {present(p + 'level3')} THEN 'Commodity: ' || {code_name(p + 'level3', False)} END",
                nonempty("Category Hierarchy", path),
                labelled("Description", f"coalesce({presence(p + 'level3_expanded')}, {p}level3)"),
                labelled("Keywords", p + "keyword"),
                labelled("Typical Manufacturers", p + "mfr"),
                labelled("Typical MPNs by Manufacturer", p + "typical_mpns"),
                f"CASE WHEN {p}global_code IS DISTINCT FROM {p}level3 AND {present(p + 'global_code')} "
                f"THEN 'Global Code: ' || {p}global_code END",
            ]
        )
        + ")"
    )


def stand_in(text: str) -> str:
    h = f"sha256({text} || '#0')"
    return (
        f"list_transform(range(1, 65), lambda i: "
        f"CAST((instr('0123456789abcdef', substr({h}, i, 1)) - 8.5::DOUBLE) / 7.5::DOUBLE AS FLOAT))"
    )


def cosine(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"list_inner_product({da}, {db}) / (sqrt(list_inner_product({da}, {da})) * sqrt(list_inner_product({db}, {db})))"


def percent(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN round(100.0::DOUBLE * CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE), 1) "
        f"ELSE 0.0::DOUBLE END"
    )


def band(c: str) -> str:
    return f"CASE WHEN {c} <= 5 THEN '0-5' WHEN {c} <= 15 THEN '5-15' WHEN {c} <= 30 THEN '15-30' ELSE '>30' END"
