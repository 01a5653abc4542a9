"""Text expressions. All are built-in JVM functions, so they stay inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions import rules

_STRIPPED = " \t\n\x0b\f\r\x00"
# Unicode white space; a blank text consists of these only.
_SPACES = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The source rules mean ASCII white space and Unicode word boundaries.
_ASCII_SPACE = r"[\t\n\x0B\f\r ]"


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (F.ltrim(c, F.lit(_SPACES)) == "")


def is_present(c: Column) -> Column:
    return c.isNotNull() & (F.ltrim(c, F.lit(_SPACES)) != "")


def strip(c: Column) -> Column:
    """Drop leading and trailing ASCII white space, not only blanks."""
    return F.btrim(c, F.lit(_STRIPPED))


def presence(c: Column) -> Column:
    """The value, or null when blank."""
    return F.when(is_present(c), c)


def lookup_key(c: Column) -> Column:
    return F.lower(strip(c))


def squeeze_key(c: Column) -> Column:
    """Lower case without any white space; catalogue values and cells are compared in this form."""
    return F.regexp_replace(F.lower(c), _ASCII_SPACE + "+", "")


def _rewrite_body(body: str) -> str:
    body = body.replace(r"[-\s]", r"[-\t\n\x0B\f\r ]").replace(r"[-/\s]", r"[-/\t\n\x0B\f\r ]")
    return body.replace(r"\s", _ASCII_SPACE)


# Borders of a word in any script, written out because ``\\b`` means different things in different runtimes.
_BEFORE = r"(?<![\p{L}\p{M}\p{N}_])"
_AFTER = r"(?![\p{L}\p{M}\p{N}_])"


def _rewrite(kind: str, body: str, text: str) -> tuple[str, str]:
    """Pattern and replacement of a rule. The first letter is looked at before the border, which costs more."""
    first = re.search("[A-Za-z]", body)
    body = _rewrite_body(body)
    if kind == "plain":
        return body, text
    if kind == "listed":
        return rf"(?imd)(^|,{_ASCII_SPACE}*){body}{_AFTER}", "$1" + text
    tail = r"(?![^(]*\))" if kind == "bare" else ""
    return rf"(?i)(?={first[0]}){_BEFORE}{body}{_AFTER}{tail}", text


def _stem(body: str) -> str:
    """Upper-case letters every match of a rule contains."""
    return max(re.split(r"[^A-Za-z0-9/&]+", re.sub(r"\[[^\]]*\]|\\s|\w\?", " ", body)), key=len).upper()


def _steps() -> list[tuple[str, str, str]]:
    """Stem, pattern and replacement of every rule in order; the rule without letters is one step per character."""
    steps = []
    for kind, body, text in rules.DESCRIPTION_REWRITES:
        if _stem(body):
            steps.append((_stem(body), *_rewrite(kind, body, text)))
        else:
            steps += [(char, char, text) for char in body.strip("[]")]
    return steps


def _holds_stem(upper: Column) -> Column:
    """False only for texts no rule can match, by plain substring tests of the text in upper case."""
    return reduce(lambda a, b: a | b, [F.contains(upper, F.lit(s)) for s in sorted({stem for stem, _, _ in _steps()})])


def _may_rewrite(c: Column) -> Column:
    """One pattern over all rules; a text that it does not match stays as it is."""
    words = "|".join(_rewrite_body(b) for k, b, _ in rules.DESCRIPTION_REWRITES if k in ("word", "bare"))
    listed = "|".join(_rewrite_body(b) for k, b, _ in rules.DESCRIPTION_REWRITES if k == "listed")
    plain = "|".join(_rewrite_body(b) for k, b, _ in rules.DESCRIPTION_REWRITES if k == "plain")
    return c.rlike(rf"(?imd)\b(?:{words})\b|(?:^|,{_ASCII_SPACE}*)(?:{listed})\b|{plain}")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value built once, however often the body names it.

    A lambda of its own also keeps a long chain out of the generated method, which the JIT would refuse.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def expand_description(c: Column) -> Column:
    """Spell out component abbreviations; blank becomes the empty string.

    A rule's pattern runs only on texts that contain the letters of the rule. The upper-case text that this is seen in is
    carried along and built anew only when a rule has changed the text. The pattern over all rules, which
    searches a long text without any match to its end, is asked only where the rules would change something.
    """

    steps = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("stem", "pattern", "new"), step)]) for step in _steps()])

    def apply(state: Column, step: Column) -> Column:
        text = state["text"]
        done = F.regexp_replace(text, step["pattern"], step["new"])
        changed = bound(done, lambda d: F.when(d == text, state).otherwise(F.struct(d.alias("text"), F.upper(d).alias("upper"))))
        return F.when(F.contains(state["upper"], step["stem"]), changed).otherwise(state)

    def rewritten(state: Column) -> Column:
        text = state["text"]
        new = F.aggregate(steps, state, apply, lambda s: s["text"])
        changed = bound(new, lambda n: F.when((n != text) & _may_rewrite(text), n).otherwise(text))
        return F.when(_holds_stem(state["upper"]), changed).otherwise(text)

    state = F.struct(c.alias("text"), F.upper(c).alias("upper"))
    return F.when(is_blank(c), F.lit("")).otherwise(strip(bound(state, rewritten)))


def expansion_is_stable(c: Column) -> Column:
    """Whether a second expansion would change nothing; a text that the first one left alone needs no second."""
    return bound(expand_description(c), lambda once: F.when(once == c, F.lit(True)).otherwise(once == expand_description(once)))


def code_name(c: Column, keep_hyphen: bool = True) -> Column:
    """Upper-case code form: other characters dropped, white space runs turned into ``_``."""
    kept = r"[^A-Za-z0-9\s,\-]" if keep_hyphen else r"[^A-Za-z0-9\s,]"
    return F.upper(F.regexp_replace(F.regexp_replace(c, kept, ""), r"\s+", "_"))


def labelled(label: str, c: Column) -> Column:
    """``label: value`` or null when the value is blank; ``concat_ws`` skips the nulls."""
    return F.when(is_present(c), F.concat(F.lit(f"{label}: "), c))


def category_path(*levels: Column) -> Column:
    return F.concat_ws(" > ", *levels)


def line_text(
    item: Column,
    mpn: Column,
    description: Column,
    manufacturer: Column,
    global_code: Column | None = None,
    levels: tuple[Column, ...] = (),
) -> Column:
    """Text of an incoming line that is embedded: stripped fields, one labelled row per present field."""
    item, mpn = strip(item), strip(mpn)
    name = F.coalesce(presence(item), mpn)
    parts = [
        F.when(is_present(name), F.concat(F.lit("Product: "), code_name(name))),
        F.when(is_present(description), F.concat(F.lit("Description: "), expand_description(strip(description)))),
        labelled("Manufacturer", strip(manufacturer)),
        labelled("MPN", mpn),
    ]
    if global_code is not None:
        parts.append(labelled("Global Code", strip(global_code)))
    if levels:
        path = category_path(*[presence(strip(level)) for level in levels])
        parts.append(F.when(path != "", F.concat(F.lit("Category Hierarchy: "), path)))
    return F.concat_ws("\n", *parts)


def stored_line_text(item: Column, mpn: Column, description: Column, manufacturer: Column) -> Column:
    """Text of a stored line: as ``line_text`` but from unstripped fields and without catalogue fields."""
    name = F.coalesce(presence(item), mpn)
    return F.concat_ws(
        "\n",
        F.when(is_present(name), F.concat(F.lit("Product: "), code_name(name))),
        F.when(is_present(description), F.concat(F.lit("Description: "), expand_description(description))),
        labelled("Manufacturer", manufacturer),
        labelled("MPN", mpn),
    )


def reference_text() -> Column:
    """Text of a catalogue row that is embedded (columns of the reference frame)."""
    level3, code = F.col("level3"), F.col("global_code")
    path = category_path(presence(F.col("level1")), presence(F.col("level2")))
    return F.concat_ws(
        "\n",
        F.when(is_present(level3), F.concat(F.lit("Commodity: "), code_name(level3, keep_hyphen=False))),
        F.when(path != "", F.concat(F.lit("Category Hierarchy: "), path)),
        labelled("Description", F.coalesce(presence(F.col("level3_expanded")), level3)),
        labelled("Keywords", F.col("keyword")),
        labelled("Typical Manufacturers", F.col("mfr")),
        labelled("Typical MPNs by Manufacturer", F.col("typical_mpns")),
        F.when(~code.eqNullSafe(level3), labelled("Global Code", code)),
    )


def text_hash(c: Column) -> Column:
    """sha256 hex of the text; a missing text hashes as the empty one."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def hash_key(c: Column) -> Column:
    """Join key of a text hash: the 32 bytes of a sha256 in hex. Any other text stays whole and is made longer than that."""
    return F.when(c.rlike(r"^[0-9a-f]{64}\z"), F.unhex(c)).otherwise(F.encode(F.concat(F.lit(" " * 33), c), "utf-8"))


def embedding_input(c: Column, limit: int = rules.TEXT_LIMIT) -> Column:
    """Text sent for a single embedding: stripped, at most ``limit`` characters."""
    return F.substring(strip(F.coalesce(c, F.lit(""))), 1, limit)


def sample_cell(c: Column, limit: int = rules.CELL_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def estimated_tokens(c: Column) -> Column:
    """A token per four characters, rounded up."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / F.lit(4)).cast("bigint")


def has_little_context(c: Column) -> Column:
    """Shorter than 10 characters, or fewer than two words of three characters and more."""
    words = F.split(c, r"[,;\s\-_|/]+")
    return (F.length(c) < 10) | (F.size(F.filter(words, lambda w: F.length(w) >= 3)) < 2)


def sample_mpns(c: Column, n: int = 3) -> Column:
    """First ``n`` entries of a comma list, or ``None`` when there is no list."""
    joined = F.array_join(F.slice(F.split(c, ","), 1, n), ", ")
    return F.coalesce(joined, F.lit("None"))
