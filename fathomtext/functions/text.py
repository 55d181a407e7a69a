"""Text functions over report Markdown: Column in, Column out, no Python on the executors."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import vocabulary as V

LINK = r"\[\[([^\]]+)\]\]"


def quoted(text: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def pattern_of(keyword: Column, pattern: Callable[[str], str]) -> Column:
    """A pattern around a keyword that each row has its own of."""
    before, after = pattern("\0").split(quoted("\0"))
    literal = F.concat(F.lit("\\Q"), F.replace(keyword, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit(before), literal, F.lit(after))


def replacement(text: Column) -> Column:
    """A literal as the replacement of regexp_replace."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def links(text: Column) -> Column:
    """All linked names in order, repeated ones too."""
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(1))


def before_financials(text: Column) -> Column:
    return F.substring_index(text, V.FINANCIALS, 1)


def linked_pattern(keyword: str) -> str:
    return rf"\[\[{quoted(keyword)}\]\]"


def bare_pattern(keyword: str) -> str:
    """The keyword, neither first nor last in a link."""
    return rf"(?<!\[\[){quoted(keyword)}(?!\]\])"


def taggable_pattern(keyword: str) -> str:
    """A bare keyword that no letter or ideograph follows."""
    return bare_pattern(keyword) + r"(?![A-Za-z一-鿿])"


def occurrences(text: Column, pattern: str | Column) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def snippets(text: Column, keyword: str | Column, pattern: str | Column | None = None, reach: int = V.SNIPPET_REACH, most: int = V.SNIPPETS) -> Column:
    """The first bare occurrences with their surroundings, on one line each."""
    word = F.lit(keyword)

    def one(parts: Column, i: Column) -> Column:
        before = F.substr(F.call_function("array_join", F.slice(parts, F.lit(1), i), word), F.lit(-reach), F.lit(reach))
        after = F.left(F.call_function("array_join", F.slice(parts, i + 1, F.size(parts)), word), F.lit(reach))
        return F.concat(F.lit("..."), strip(F.replace(F.concat(before, word, after), F.lit("\n"), F.lit(" "))), F.lit("..."))

    def first(parts: Column) -> Column:
        n = F.least(F.lit(most), F.size(parts) - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: one(parts, i))).otherwise(F.array().cast("array<string>"))

    return let(F.split(text, bare_pattern(keyword) if pattern is None else pattern, -1), first)


def h2_body(text: Column, header: str) -> Column:
    """The text between a heading's line and the next H2 heading or the end; null without the heading."""
    found = F.regexp_extract(text, rf"(?s){quoted(header)}[^\n]*\n(.*?)(?=\n## |\z)", 1)
    return F.when(F.contains(text, F.lit(header)), found)


def split_section(text: Column, name: str) -> Column:
    """A section as a plain split at "## " gives it: it ends at the first heading of any lower level; the last of the name wins."""
    parts = F.filter(F.split(text, "## "), lambda x: F.startswith(x, F.lit(name)))
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("")


def section_role(text: Column, keyword: str | Column) -> Column:
    """The first of business, supply chain and customers whose body holds the keyword, else mentioned."""
    holds = lambda h: F.coalesce(F.contains(h2_body(text, h), F.lit(keyword)), F.lit(False))
    return F.when(holds(V.BUSINESS), "core_business").when(holds(V.SUPPLY_CHAIN), "supply_chain").when(holds(V.CUSTOMERS), "customer_supplier").otherwise("mentioned")


def positional_role(chain: Column, tag: Column | str, roles: dict[str, str] | None = None, reach: int = V.ROLE_REACH) -> Column:
    """The role word, in fixed order of precedence, in the characters before the tag's first occurrence; else related."""
    needle = F.lit(tag) if isinstance(tag, str) else tag
    window = F.right(F.left(chain, F.position(needle, chain) - 1), F.lit(reach))
    out = F.lit("related")
    for word, role in reversed((roles or V.ROLES).items()):
        out = F.when(F.contains(window, F.lit(word)), role).otherwise(out)
    return F.when(F.contains(chain, needle), out).otherwise("related")


def is_cjk(name: Column) -> Column:
    """Over three tenths of the characters are CJK ideographs."""
    return F.regexp_count(name, F.lit("[一-鿿]")) > F.length(name) * 0.3


def categorize(name: Column, tech: list[str] | None = None, material: list[str] | None = None, application: list[str] | None = None) -> Column:
    """Technology, then material, then application by list; companies by script."""
    tech = V.TECH_TERMS if tech is None else tech
    material = V.MATERIAL_TERMS if material is None else material
    application = V.APPLICATION_TERMS if application is None else application
    return (
        F.when(name.isin(*tech), "technology").when(name.isin(*material), "material").when(name.isin(*application), "application")
        .when(is_cjk(name), "taiwan_company").otherwise("international_company")
    )


def categorize_for_index(name: Column) -> Column:
    """The same over the index's larger technology list and without 5G among applications."""
    return categorize(name, V.TECH_TERMS + V.INDEX_ONLY_TECH_TERMS, V.MATERIAL_TERMS, [x for x in V.APPLICATION_TERMS if x != "5G"])


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def canonical(name: Column, aliases: dict[str, str] | None = None) -> Column:
    return F.coalesce(literal_map(V.ALIASES if aliases is None else aliases)[name], name)


def collapse_repeats(text: Column) -> Column:
    """[[X]] ([[X]]), brackets of either width, becomes [[X]]."""
    return F.regexp_replace(text, r"(?U)\[\[([^\]]+)\]\]\s*[(（]\[\[\1\]\][)）]", "[[$1]]")


def resolved(aliases: dict[str, str]) -> dict[str, str]:
    """What each name becomes when the aliases are replaced one after the other, in their order; names that stay are left out."""
    out = {}
    for name in aliases:
        now = name
        for alias, canon in aliases.items():
            now = canon if now == alias else now
        out[name] = now
    return {a: c for a, c in out.items() if a != c}


def looked_up(name: Column, values: dict[str, str]) -> Column:
    """The value of a name, null without one, in a time that does not depend on how many there are: a map of about one entry for each hash."""
    size = 1 << max(0, len(values) - 1).bit_length()
    slots: list[dict[str, str]] = [{} for _ in range(size)]
    for k, v in values.items():
        slots[zlib.crc32(k.encode()) % size][k] = v
    empty = F.create_map().cast("map<string,string>")
    table = F.array(*(literal_map(s) if s else empty for s in slots))
    return F.get(table, (F.crc32(name.cast("binary")) % size).cast("int"))[name]


def rename_links(text: Column, aliases: dict[str, str]) -> Column:
    """Linked aliases become their canonical names, as if replaced one after the other, in one pass: cut at the links, look up, put together."""
    values = resolved(aliases)
    if not values:
        return text
    if any("[" in x or "]" in x for p in aliases.items() for x in p):
        raise ValueError("names with brackets cannot be looked up")
    link = r"\[\[([^\[\]]+)\]\]"
    names = F.regexp_extract_all(text, F.lit(link), F.lit(1))
    new = F.transform(names, lambda n: F.concat(F.lit("[["), F.coalesce(looked_up(n, values), n), F.lit("]]")))
    # a part before each link and one behind the last
    return F.array_join(F.zip_with(F.split(text, link, -1), new, lambda part, link: F.concat(part, F.coalesce(link, F.lit("")))), "")


def normalize_links(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Aliases to canonical names and repeats collapsed, before the financial section only; texts without it stay.

    All that follows the section's heading is kept, a second heading too.
    """
    head = before_financials(text)
    named = rename_links(head, V.ALIASES if aliases is None else aliases)
    return F.when(F.contains(text, F.lit(V.FINANCIALS)), F.concat(collapse_repeats(named), F.substr(text, F.length(head) + 1))).otherwise(text)


def tag_keyword(text: Column, keyword: str, guarded: bool = True) -> tuple[Column, Column]:
    """(rewritten text, number of tags): taggable occurrences become links; guarded texts need a financial section, which is left alone."""
    head = before_financials(text) if guarded else text
    ok = F.contains(text, F.lit(V.FINANCIALS)) if guarded else F.lit(True)
    pattern = taggable_pattern(keyword)
    new = F.concat(F.regexp_replace(head, F.lit(pattern), replacement(F.lit(f"[[{keyword}]]"))), F.substr(text, F.length(head) + 1))
    return F.when(ok, new).otherwise(text), F.when(ok, occurrences(head, pattern)).otherwise(F.lit(0).cast("long"))


def replace_section(text: Column, header: str, body: Column, following: str | None = None) -> Column:
    """The text between a heading and the next given one, or to the end, replaced; unchanged without both."""
    if following is None:
        return F.when(F.contains(text, F.lit(header)), F.concat(F.substring_index(text, header, 1), F.lit(header + "\n"), body, F.lit("\n"))).otherwise(text)
    return F.regexp_replace(text, F.lit(rf"(?s)({quoted(header)}\n)(.*?)(?=\n{quoted(following)})"), F.concat(F.lit("$1"), replacement(body), F.lit("\n")))


def replace_financials(text: Column, new: Column) -> Column:
    """The financial section replaced, or appended where there is none."""
    return F.when(F.contains(text, F.lit(V.FINANCIALS)), F.concat(before_financials(text), new)).otherwise(F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n\n"), new))


def replace_valuation(text: Column, new: Column) -> Column:
    """The valuation block replaced, or put before the annual heading of a financial section."""
    swapped = F.regexp_replace(text, F.lit(rf"(?s){quoted(V.VALUATION_TITLE)}.*?(?=\n### 年度)"), F.concat(replacement(new), F.lit("\n")))
    annual = "### 年度關鍵財務數據"
    inserted = F.replace(text, F.lit(annual), F.concat(new, F.lit("\n\n" + annual)))
    return F.when(F.contains(text, F.lit(V.VALUATION_TITLE)), swapped).when(F.contains(text, F.lit(V.FINANCIALS)), inserted).otherwise(text)


def patch_metadata(text: Column, market_cap: Column, enterprise_value: Column) -> Column:
    """New figures before the unit; an empty or missing one leaves the line alone."""
    for label, value in (("市值", market_cap), ("企業價值", enterprise_value)):
        new = F.regexp_replace(text, F.lit(rf"(\*\*{label}:\*\*) .+?{V.UNIT}"), F.concat(F.lit("$1 "), replacement(value), F.lit(f" {V.UNIT}")))
        text = F.when(F.coalesce(F.length(value), F.lit(0)) > 0, new).otherwise(text)
    return text


def folder_name(name: Column) -> Column:
    return strip(F.regexp_replace(name, r'[<>:"/\\|?*]', ""))


def file_stem(name: Column) -> Column:
    return F.translate(name, " /", "__")


def industry_line(text: Column) -> Column:
    """The value of the first industry line, or null."""
    return F.nullif(strip(F.regexp_extract(text, r"(?m)^\s*\*\*產業:\*\*[ \t]*(.*)$", 1)), F.lit(""))


def right_justified(value: Column, width: Column) -> Column:
    return F.when(F.length(value) >= width, value).otherwise(F.lpad(value, width, F.lit(" ")))
