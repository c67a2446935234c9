"""What is read from source texts with regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The CSS colour names.
COLOR_NAMES = (
    "aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral cornflowerblue "
    "cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange darkorchid darkred darksalmon "
    "darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey dodgerblue firebrick floralwhite forestgreen "
    "fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki lavender lavenderblush lawngreen lemonchiffon "
    "lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink lightsalmon lightseagreen lightskyblue lightslategray lightslategrey "
    "lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue mediumspringgreen "
    "mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange orangered orchid palegoldenrod palegreen "
    "paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple rebeccapurple red rosybrown royalblue saddlebrown salmon sandybrown seagreen seashell "
    "sienna silver skyblue slateblue slategray slategrey snow springgreen steelblue tan teal thistle tomato turquoise violet wheat white whitesmoke yellow yellowgreen"
).split()
COLOR_FUNCTIONS = "rgba?|hsla?|hwb|lab|lch|oklab|oklch|color"


def line_count(text: Column) -> Column:
    """Lines of a text: a last line break ends a line and begins none; an empty text has none."""
    n = F.size(F.split(text, r"\r?\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n).cast("long")


def without_comments(text: Column) -> Column:
    """Block and line comments blanked, their line breaks kept; strings are read first, so what looks like a comment in them stays."""
    token = r"""(?s)("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|/\*.*?(?:\*/|\z)|//[^\n]*"""
    kept = F.regexp_replace(text, token, "$1")
    lines = F.regexp_replace(text, r"""(?s)("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*""", "$1")
    return F.when(lines.contains("/*"), kept).otherwise(lines)


def meaningful_lines(text: Column) -> Column:
    """Lines that hold something besides white space and comments."""
    return F.coalesce(F.size(F.filter(F.split(without_comments(text), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\r\t]", " ")) != "")), F.lit(0)).cast("long")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")).cast("long")


def markup_only(page: Column) -> Column:
    """A page without its comments and the bodies of script, style, textarea and title, however long the tags before them are."""
    hidden = r"(?is)<!--.*?(?:-->|\z)|(<(script|textarea|title|style)\b[^>]*>).*?(?=</\2|\z)"
    return F.regexp_replace(page, hidden, "$1")


def style_tags(page: Column) -> Column:
    """Start tags of style elements and tags with a style attribute, in page order."""
    return F.regexp_extract_all(markup_only(page), F.lit(r"""(?is)<style\b[^>]*>|<[a-z][a-z0-9-]*\b(?:[^>"']|"[^"]*"|'[^']*')*?\sstyle\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)(?:[^>"']|"[^"]*"|'[^']*')*>"""), F.lit(0))


def css_colors(text: Column) -> Column:
    """Sorted distinct colours in a piece of CSS: hexadecimal, functions and names; urls and strings are skipped, and so are transparent
    and currentcolor. Words are found as such and then looked up, not tried name by name at each character."""
    plain = F.regexp_replace(F.lower(text), r"""url\([^)]*\)|"[^"]*"|'[^']*'""", " ")
    pattern = rf"(?:#(?:[0-9a-f]{{8}}|[0-9a-f]{{6}}|[0-9a-f]{{3,4}})(?![0-9a-z_-]))|(?:\b(?:{COLOR_FUNCTIONS})\([^()]*\))|(?:(?<![\w.#$-])[a-z]++(?![\w(-]))"
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)))
    return F.sort_array(F.filter(found, lambda x: x.startswith("#") | x.endswith(")") | x.isin(COLOR_NAMES)))


def links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r"""href="([^"]*)\""""), F.lit(1))


def toml_string(manifest: Column, section: str, key: str) -> Column:
    """A string of a TOML section; null where there is none."""
    body = F.regexp_extract(F.concat(F.lit("\n"), manifest), rf"(?s)\n\[{section}\][^\n]*\n(.*?)(?=\n\[|\z)", 1)
    return F.nullif(F.regexp_extract(F.concat(F.lit("\n"), body), rf"""\n\s*{key}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def rounded_percent(ratio: Column) -> Column:
    """Half rounds up."""
    return F.floor(ratio * 100 + 0.5).cast("long")
