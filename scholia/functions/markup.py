"""Markup to text: one pass over the tags, then all character references.

Everything is column arithmetic in the JVM.  The SQL forms for the oracle
are written beside the Spark forms and share their patterns, which hold no
look-around, back-references or possessive repeats.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_TAGS = "p|div|br|li|ul|ol|tr|td|th|table|h1|h2|h3|h4|h5|h6|title|section|article|header|footer|nav|blockquote|pre|hr"
#: Elements whose content is not text.
RAW_TAGS = ("script", "style")

# What stands between a tag's name and its ">", which quoted values may hold; a tag has at most 200 of those.
_ATTRIBUTES = r"""[^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*){0,200}"""
#: One token of markup. Groups: openings of comments and raw elements, then the name of a block tag.
TOKEN = "(?is)" + "|".join([
    r"(?:(<!--).*?(?:-->|\z))",
    *[rf"(?:(<{t})(?:[\s/]{_ATTRIBUTES})?>.*?(?:</{t}\s*>|\z))" for t in RAW_TAGS],
    rf"(?:</?({BLOCK_TAGS})(?:[\s/]{_ATTRIBUTES})?>)",
    rf"(?:</?[a-z][^\s/>'\"]*(?:[\s/]{_ATTRIBUTES})?>)",
    r"(?:</?[a-z][^>]*>)",                 # quotes that don't match: up to the first ">"
    r"(?:<!\[CDATA\[|\]\]>|<[!?/][^>]*>)",
])
# groups of TOKEN by number: comment, raw elements, block name
_RAW_GROUPS = range(1, 2 + len(RAW_TAGS))
_BLOCK_GROUP = 2 + len(RAW_TAGS)
_MARKS = "\u0001\u0002\u0003"
# what a token became -> what stands for it in the text
_STANDS = [("\u0001\u0002\u0003", ""), ("\u0001[^\u0002]+\u0002\u0003", "\n"), ("\u0001\u0002[^\u0003]+\u0003", " "),
           ("[ \\t\\f\\r\u00a0]+", " "), (" ?\\n[ \\n]*", "\n"), ("^\\s+|\\s+$", "")]

#: All named references of HTML, the ones met most first (a map is searched in order).
NAMES = {n: html5[n] for n in ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", *html5] if n.endswith(";")}
#: Those that also count without ";", a longer one before its own beginnings.
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
NUMBER = r"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?)"
NAME = r"^([A-Za-z][A-Za-z0-9]{1,31};)"
BARE = f"^({_BARE})"


def _codes() -> dict[int, str]:
    """Code points that stand for another text: those of Windows-1252, NUL, and the byte order mark (itself)."""
    out = {0: "\ufffd", 0x0D: "\r", 0xFEFF: "\ufeff"}
    for b in range(0x80, 0xA0):
        try:
            out[b] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


CODES = _codes()
# code points that stand for nothing
_NOTHING = "({c} BETWEEN 1 AND 8 OR {c} = 11 OR {c} BETWEEN 14 AND 31 OR {c} = 127 OR {c} BETWEEN 64976 AND 65007 OR {c} % 65536 >= 65534)"
_NO_CHARACTER = "({c} BETWEEN 55296 AND 57343 OR {c} > 1114111)"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _one_reference(p: Column, names: Column, codes: Column) -> Column:
    """The text after an "&" with the reference at its start decoded (the "&" itself if there is none)."""
    found = F.transform(F.array(F.struct(p.alias("p"), F.regexp_extract(p, NUMBER, 1).alias("number"), F.regexp_extract(p, NAME, 1).alias("name"))), lambda s: F.struct(
        s["p"].alias("p"), s["number"].alias("number"), F.length(s["number"]).alias("n"), F.length(s["name"]).alias("m"), F.element_at(names, s["name"]).alias("named"),
        F.regexp_replace(s["number"], "^#[xX]?0*|;$", "").alias("digits")))
    found = F.transform(found, lambda s: F.struct(
        s["p"].alias("p"), s["n"].alias("n"), s["m"].alias("m"), s["named"].alias("named"),
        F.when(s["named"].isNull(), F.regexp_extract(s["p"], BARE, 1)).otherwise(F.lit("")).alias("bare"),
        F.when(s["digits"] == "", F.lit(0)).when(F.length(s["digits"]) > 7, F.lit(1114112)).otherwise(
            F.when(F.lower(s["number"]).startswith("#x"), F.conv(s["digits"], 16, 10)).otherwise(s["digits"]).cast("int")).alias("code")))

    def text(s: Column) -> Column:
        code = s["code"]
        no_character = (code.between(55296, 57343)) | (code > 1114111)
        nothing = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(64976, 65007) | (code % 65536 >= 65534)
        character = F.when(F.element_at(codes, code).isNotNull(), F.element_at(codes, code)).when(no_character, F.lit("\ufffd")).when(nothing, F.lit("")) \
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(s["n"] > 0, F.concat(character, F.substr(s["p"], s["n"] + 1))) \
            .when(s["named"].isNotNull(), F.concat(s["named"], F.substr(s["p"], s["m"] + 1))) \
            .when(s["bare"] != "", F.concat(F.element_at(names, F.concat(s["bare"], F.lit(";"))), F.substr(s["p"], F.length(s["bare"]) + 1))) \
            .otherwise(F.concat(F.lit("&"), s["p"]))

    return F.transform(found, text)[0]


def decode_references(col: Column | str) -> Column:
    """Decode named, decimal and hexadecimal character references by the rules of HTML5.

    Old names count without ";" too; what is no reference stays; numbers that
    name no character become U+FFFD, forbidden ones nothing; null stays null."""
    t = F.col(col) if isinstance(col, str) else col
    names, codes = _map(NAMES), _map(CODES)
    parts = F.split(t, "&")
    decoded = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: _one_reference(p, names, codes))
    return F.when(F.contains(t, F.lit("&")), F.concat(parts[0], F.array_join(decoded, ""))).otherwise(t)


def markup_to_text(col: Column | str) -> Column:
    """XML/HTML to plain text.

    Script and style elements and comments become a blank, also where they
    are not closed; block tags become line breaks; other tags, declarations
    and the marks of CDATA go; quoted attribute values may hold ">".  Then
    character references are decoded, and blanks and empty lines squeezed.
    The control characters 1 to 3 are dropped; a "<" that opens no tag stays.
    """
    t = F.translate(F.col(col) if isinstance(col, str) else col, _MARKS, "")
    raw = "".join(f"${g}" for g in _RAW_GROUPS)
    t = F.regexp_replace(t, TOKEN, f"\u0001${_BLOCK_GROUP}\u0002{raw}\u0003")
    for i, (pattern, stands) in enumerate(_STANDS):
        t = F.regexp_replace(decode_references(t) if i == 3 else t, pattern, stands)
    return t


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def references_sql(t: str) -> str:
    """SQL (DuckDB) form of decode_references."""
    names = f"MAP([{', '.join(map(_quoted, NAMES))}], [{', '.join(map(_quoted, NAMES.values()))}])"
    codes = f"MAP([{', '.join(map(str, CODES))}], [{', '.join('chr(%d)' % ord(c) for c in CODES.values())}])"
    first = f"{{'p': p, 'number': regexp_extract(p, {_quoted(NUMBER)}, 1), 'name': regexp_extract(p, {_quoted(NAME)}, 1), 'bare': regexp_extract(p, {_quoted(BARE)}, 1)}}"
    digits = "regexp_replace(s.number, '^#[xX]?0*|;$', '', 'g')"
    code = f"CASE WHEN {digits} = '' THEN 0 WHEN len({digits}) > 7 THEN 1114112 WHEN lower(s.number) LIKE '#x%' THEN ('0x' || {digits})::INTEGER ELSE {digits}::INTEGER END"
    second = f"{{'p': s.p, 'number': s.number, 'name': s.name, 'bare': s.bare, 'named': {names}[s.name], 'code': CASE WHEN s.number <> '' THEN {code} END}}"
    character = (f"CASE WHEN {codes}[s.code] IS NOT NULL THEN {codes}[s.code] WHEN {_NO_CHARACTER.format(c='s.code')} THEN chr(65533) "
                 f"WHEN {_NOTHING.format(c='s.code')} THEN '' ELSE chr(s.code) END")
    text = (f"CASE WHEN s.number <> '' THEN {character} || substr(s.p, len(s.number) + 1) WHEN s.named IS NOT NULL THEN s.named || substr(s.p, len(s.name) + 1) "
            f"WHEN s.bare <> '' THEN {names}[s.bare || ';'] || substr(s.p, len(s.bare) + 1) ELSE '&' || s.p END")
    parts = f"string_split({t}, '&')[2:]"
    steps = f"list_transform(list_transform(list_transform({parts}, lambda p: {first}), lambda s: {second}), lambda s: {text})"
    return f"CASE WHEN contains({t}, '&') THEN string_split({t}, '&')[1] || array_to_string({steps}, '') ELSE {t} END"


def markup_sql(column: str, table: str, keep: str) -> str:
    """SELECT ``keep`` and the text of ``column`` as ``text`` from ``table`` (a relation)."""
    raw = "".join(rf"\{g}" for g in _RAW_GROUPS)
    t = f"regexp_replace(translate({column}, {_quoted(_MARKS)}, ''), {_quoted(TOKEN)}, {_quoted(chr(1) + chr(92) + str(_BLOCK_GROUP) + chr(2) + raw + chr(3))}, 'g')"
    for pattern, stands in _STANDS[:3]:
        t = f"regexp_replace({t}, {_quoted(pattern)}, {_quoted(stands)}, 'g')"
    inner = f"SELECT {keep}, {t} AS _bare FROM {table}"
    t = "_decoded"
    for pattern, stands in _STANDS[3:]:
        t = f"regexp_replace({t}, {_quoted(pattern)}, {_quoted(stands)}, 'g')"
    return f"SELECT {keep}, {t} AS text FROM (SELECT {keep}, {references_sql('_bare')} AS _decoded FROM ({inner}))"
