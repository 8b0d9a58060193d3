"""References of links resolved against their page's URL (RFC 3986, section 5), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a URI: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment.
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
HAS_AUTHORITY, HAS_QUERY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//", r"^[^?#]*\?"


def part(uri: Column, nth: int) -> Column:
    return F.regexp_extract(uri, PARTS, nth)


def without_dots(path: Column) -> Column:
    """An absolute path without its . and .. segments; another path as it is."""
    segments = F.split(path, "/")
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.lit(""), lambda done, s: F.when(s == ".", done).when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), s)))
    return F.when(path.startswith("/"), F.concat(kept, F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise(""))).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """The absolute URI that a reference on page `base` means; null if either is null. White space around the reference is dropped."""
    ref = F.regexp_replace(reference, r"^\s+|\s+$", "")
    scheme, path = part(ref, 1), part(ref, 3)
    own, there, asks = scheme != "", ref.rlike(HAS_AUTHORITY), ref.rlike(HAS_QUERY)
    before = F.when(base.rlike(HAS_AUTHORITY) & (part(base, 3) == ""), "/").otherwise(F.regexp_replace(part(base, 3), "[^/]*$", ""))
    target = F.when(own | there | path.startswith("/"), without_dots(path)).when(path == "", part(base, 3)).otherwise(without_dots(F.concat(before, path)))
    authority = F.when(own | there, F.when(there, F.concat(F.lit("//"), part(ref, 2))).otherwise("")).otherwise(F.when(base.rlike(HAS_AUTHORITY), F.concat(F.lit("//"), part(base, 2))).otherwise(""))
    query = F.when(asks, F.concat(F.lit("?"), part(ref, 4))).when(~own & ~there & (path == "") & base.rlike(HAS_QUERY), F.concat(F.lit("?"), part(base, 4))).otherwise("")
    fragment = F.when(ref.contains("#"), F.concat(F.lit("#"), part(ref, 5))).otherwise("")
    return F.concat(F.when(own, scheme).otherwise(part(base, 1)), F.lit(":"), authority, target, query, fragment)


def duck_resolve(base: str, ref: str) -> str:
    """The same in DuckDB's SQL."""
    p = lambda x, n: f"regexp_extract({x}, '{PARTS}', {n})"
    has = lambda x, rx: f"regexp_matches({x}, '{rx}')"
    dots = lambda x: f"CASE WHEN starts_with({x}, '/') THEN list_reduce(list_prepend('', list_transform(string_split({x}, '/')[2:], lambda s: s)), lambda done, s: CASE s WHEN '.' THEN done WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || s END) || CASE WHEN string_split({x}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {x} END"
    own, there, path = f"{p(ref, 1)} <> ''", has(ref, HAS_AUTHORITY), p(ref, 3)
    before = f"CASE WHEN {has(base, HAS_AUTHORITY)} AND {p(base, 3)} = '' THEN '/' ELSE regexp_replace({p(base, 3)}, '[^/]*$', '') END"
    target = f"CASE WHEN {own} OR {there} OR starts_with({path}, '/') THEN {dots(path)} WHEN {path} = '' THEN {p(base, 3)} ELSE {dots(f'({before} || {path})')} END"
    authority = f"CASE WHEN {there} THEN '//' || {p(ref, 2)} WHEN {own} OR NOT {has(base, HAS_AUTHORITY)} THEN '' ELSE '//' || {p(base, 2)} END"
    query = f"CASE WHEN {has(ref, HAS_QUERY)} THEN '?' || {p(ref, 4)} WHEN NOT ({own}) AND NOT {there} AND {path} = '' AND {has(base, HAS_QUERY)} THEN '?' || {p(base, 4)} ELSE '' END"
    fragment = f"CASE WHEN contains({ref}, '#') THEN '#' || {p(ref, 5)} ELSE '' END"
    return f"(CASE WHEN {own} THEN {p(ref, 1)} ELSE {p(base, 1)} END || ':' || ({authority}) || ({target}) || ({query}) || ({fragment}))"
