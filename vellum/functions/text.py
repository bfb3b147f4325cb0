"""Text normalisation, slugs, highlighting and formatting as Column expressions.

Letters, digits and word boundaries are ASCII unless a function says otherwise; white space is the wide class below.
"""

from __future__ import annotations

import html as html_entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space in the wide sense: ASCII white space, no-break, Ogham, en to hair, line, paragraph, narrow, mathematical and ideographic spaces, byte-order mark.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same signs as a list, for functions that look at the ends of a text only.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: Words kept lower-case inside titles, and known acronyms.
MINOR_WORDS = ("of", "the", "a", "an", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "in", "with", "from")
ACRONYMS = ("eus", "ercp", "tppt", "hcp", "hcps", "mri", "ct", "iv", "gi", "esd", "poem", "emr", "mte", "md", "phd", "fna", "fnb", "dfi", "lams", "ldtt", "ltt", "scr", "rsa", "rtsa", "stam", "cpd", "nhs", "uk")
#: The first line of a page that carries furniture, and the running headers that may follow it.
PAGE_HEADER = r"^MEDTECH EUROPE\s+[-–]\s+CODE OF ETHICAL BUSINESS PRACTICE"
RUNNING_HEADER = r"^(?:SCOPE|ADMINISTERING THE CODE|INTRODUCTION|CHAPTER \d+:.+|PART 2:.+|PART 3:.+)$"
#: Tags that break lines, and tags whose content isn't visible.
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
HIDDEN_TAGS = ("script", "style", "svg")
#: Fixed value: what may lead a line as its bullet.
BULLET = r"^[•\-*–—◦▪▫◆◇▶►➔→.·]|^[a-zA-Z0-9]+[.)]|^\([a-zA-Z0-9]+\)"
BULLET_SIGNS = "•‣◦⁃∙"
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: The references that pages are written with, but for ``&amp;``.
LISTED = (("&copy;", "©"), ("&middot;", "·"), *ENTITIES[:-1])
#: Between a letter, digit or ``_`` of ASCII and anything else.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _replace(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def quoted(term: str) -> str:
    """A pattern that matches ``term`` literally."""
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in term)


def any_of(terms: tuple[str, ...]) -> str:
    """A pattern of any of the terms, literally; signs that can begin one are tested first, as most signs can't."""
    return f"(?=[{''.join(sorted({quoted(t[0]) for t in terms}))}])(?:{'|'.join(quoted(t) for t in terms)})"


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def trim_held(text: Column) -> Column:
    """The same for what is a column or variable already, as it is read more than once: most texts begin and end with a sign of
    ASCII that is no space, which is seen far sooner."""
    seen = lambda sign: F.ascii(sign).between(33, 126)
    return F.when(seen(text) & seen(F.right(text, F.lit(1))), text).otherwise(trim(text))


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(trim(text)) > 0, text)


#: Blanks around line ends and double blanks, and what each of the three holds; white space between ``:`` or ``.`` and two digits.
BLANKS, ANY_BLANKS = ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " ")), r"[ \t][ \t\n]|\n[ \t]"
TIME_GAP = (rf"([:.]){SPACE}+(?=[0-9]{{2}}(?![A-Za-z0-9_]))", "$1")


def normalize_source(text: Column) -> Column:
    """Tidy pasted text: no-break spaces, blanks around line ends, double blanks, white space between ``:`` or ``.`` and two
    digits (line ends too), more than one empty line. Null becomes empty."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return trim(_replace(plain, *BLANKS, TIME_GAP, (r"\n{3,}", "\n\n")))


def normalized_source(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with ``column`` tidied by normalize_source. Each step is a column of its own, so it can be tested first whether
    there is anything to do."""
    text = F.col(column)
    rows = docs.withColumn(column, F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")))
    rows = rows.withColumn(column, F.when(text.rlike(ANY_BLANKS), _replace(text, *BLANKS)).otherwise(text))
    rows = rows.withColumn(column, F.when(text.rlike(rf"[:.]{SPACE}"), _replace(text, TIME_GAP)).otherwise(text))
    rows = rows.withColumn(column, F.when(F.contains(text, F.lit("\n\n\n")), _replace(text, (r"\n{3,}", "\n\n"))).otherwise(text))
    return rows.withColumn(column, trim_held(text))


def normalize_layout(text: Column, remove_wrap_hyphens: bool = False) -> Column:
    """One line of text: line ends unified, soft hyphens gone, hyphens at line ends joined, bullets and white space to one space."""
    text = _replace(F.coalesce(text, F.lit("")), (r"\r\n?", "\n"), (r"\u00a0", " "), (r"\u00ad", ""))
    if remove_wrap_hyphens:
        text = _replace(text, (r"(?<=[A-Za-z])-\s*\n\s*(?=[a-z])", ""))
    else:
        text = _replace(text, (r"-\s*\n\s*(?=[\p{L}\p{N}_])", "-"))
    return F.trim(_replace(text, (f"[{BULLET_SIGNS}]", " "), (rf"(?:{SPACE}|[\u001c-\u001f\u0085])+", " ")))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def words_only(text: Column, fold: bool = False) -> Column:
    joined = F.array_join(words(text), " ")
    return F.lower(joined) if fold else joined


def tokens(text: Column) -> Column:
    """Words with inner apostrophes, and each other sign by itself."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s\u00a0]"), F.lit(0))


def squash(text: Column) -> Column:
    """Only ASCII letters and digits, lower-case."""
    return F.translate(_replace(text, ("[^A-Za-z0-9]+", "")), UPPER, LOWER)


def strip_question_prefix(text: Column) -> Column:
    return _replace(text, (r"^(?i:Q&A)\s+[^:]+:\s*", ""))


def strip_leading_marker(text: Column) -> Column:
    return trim(_replace(text, (BULLET, "")))


#: A character reference as HTML reads it; one of no known name stays as it is.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _decoded(found: pd.Series) -> pd.Series:
    return found.map(lambda own: [html_entities.unescape(r) for r in own], na_action="ignore")


def decode_references(text: Column) -> Column:
    """All character references decoded in one pass: decimal and hexadecimal ones, and every name of HTML, the longest that
    fits where its ``;`` is missing. Only the references leave the JVM, not the texts around them."""
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    own = _decoded(F.when(F.contains(text, F.lit("&")), found))
    joined = F.zip_with(F.split(text, REFERENCE, -1), own, lambda gap, sign: F.concat(gap, F.coalesce(sign, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(joined, "")).otherwise(text)


def _outside_tags(html: Column, gap: str) -> Column:
    """Hidden elements, comments and tags to ``gap``, block tags to line ends."""
    for tag in HIDDEN_TAGS:
        html = _replace(html, (rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>.*?</{tag}[\t\n\f\r ]*>", gap))
    return _replace(html, (r"(?s)<!--.*?-->", gap), (rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?![A-Za-z0-9])[^>]*>", "\n"), (r"<[^>]*>", gap))


def visible_text(html: Column) -> Column:
    """Text outside tags, a line end for each block tag, nothing of hidden elements; references decoded.

    A reference ends where a tag begins: tags leave a sign behind (U+FFFF) that is taken out after decoding.
    """
    return F.replace(decode_references(_outside_tags(html, "\uffff")), F.lit("\uffff"), F.lit(""))


def listed_text(html: Column) -> Column:
    """The same with the references of LISTED alone decoded, wherever they stand once the tags are gone; of these only
    ``&amp`` may lack its end."""
    text = _outside_tags(html, "")
    for reference, sign in LISTED:
        text = F.replace(text, F.lit(reference), F.lit(sign))
    return _replace(text, ("&amp;?", "&"))


def decode_entities(text: Column) -> Column:
    """The six common entities, one after the other, ``&amp;`` last."""
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def strip_html(html: Column, gap: str = "") -> Column:
    """Tags to ``gap`` (line breaks to line ends), entities decoded, blanks collapsed."""
    text = _replace(F.coalesce(html, F.lit("")), (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", gap))
    return trim(_replace(decode_entities(text), (r"[ \t]+", " ")))


def sanitize_html(html: Column) -> Column:
    """Without script, style, frame and object elements, event attributes and javascript: links. Not a security boundary."""
    html = _replace(html, (r"(?is)<(script|style|iframe|object|embed)\b[^>]*>.*?</\1\s*>", ""), (r"(?i)</?(?:script|style|iframe|object|embed)\b[^>]*>", ""))
    return _replace(html, (r"""(?i)\s+on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", ""), (r"""(?i)(href|src)\s*=\s*(["']?)\s*javascript:[^"'>\s]*""", "$1=$2#"))


def remove_page_furniture(page: Column) -> Column:
    """Drop the fixed header line of a page and, only then, a page number and a running header after it."""
    lines = F.transform(F.split(F.replace(page, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: _replace(x, (r"\s+$", "")))
    drop = lambda test: lambda x: F.when(test(F.trim(F.coalesce(F.get(x, F.lit(0)), F.lit("")))) & (F.size(x) > 0), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x)
    shorter = drop(lambda t: t.rlike(r"^[0-9]+$"))(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    shorter = drop(lambda t: t.rlike(RUNNING_HEADER))(shorter)
    return F.array_join(F.when(F.trim(lines[0]).rlike(PAGE_HEADER), shorter).otherwise(lines), "\n")


def is_furniture_line(line: Column) -> Column:
    """Page markers, the fixed header, bare numbers and short lines in capitals."""
    line = F.trim(line)
    return line.rlike(r"^--- PAGE [0-9]+ ---$") | line.rlike(PAGE_HEADER) | line.rlike(r"^[0-9]+$") | (line.rlike("[A-Z]") & ~line.rlike("[a-z]") & (F.length(line) < 40))


def _word(t: str, later: str) -> str:
    letters = f"regexp_replace({t}, '[^a-zA-Z]', '')"
    among = lambda x, values: f"{x} in ({', '.join(repr(v) for v in values)})"
    chunks = f"regexp_extract_all({t}, '[a-zA-Z]+', 0)"
    pieces = f"regexp_extract_all(lower({t}), '[^-/]*[-/]|[^-/]+', 0)"
    capital = f"array_join(transform({pieces}, p -> if(p rlike '^[a-z]', concat(upper(left(p, 1)), substring(p, 2)), p)), '')"
    return f"""case when {t} rlike '[a-z]' or not {t} rlike '[A-Z]' then {t}
        when {among(f'lower({letters})', ACRONYMS)} then upper({t})
        when size({chunks}) > 1 and forall({chunks}, c -> length(c) <= 5 and {among('lower(c)', ACRONYMS)}) then upper({t})
        when {among(f'lower({letters})', MINOR_WORDS)} and {later} then lower({t})
        else {capital} end"""


def capitalize(column: str) -> Column:
    """Title case for words in capitals, line by line and between ``•``, ``|`` and ``:``; other words stay.

    Known acronyms and compounds of them go upper, minor words lower unless they are the first word of their stretch, all
    others get a capital at the start and after ``-`` and ``/``. A run of separators leaves its last one, and white space
    next to it is lost. Texts without separators and words in capitals only have their lines trimmed.
    """
    ends = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    tr = lambda x: f"trim(BOTH '{ends}' FROM {x})"
    space = SPACE.replace("\\", "\\\\")
    inner = space[1:-1]
    # a class of many ranges is slow, so ASCII signs pass by a range of their own
    parts = f"regexp_extract_all(g, '{space}+|(?:[!-~]++|[^{inner}])+', 0)"
    # whether a word stands before it; exists stops at the first, so a stretch isn't read anew for each of its words
    word = _word("t", "exists(slice(ts, 1, i), y -> y rlike '[a-zA-Z]')")
    stretch = f"array_join(flatten(transform(array({parts}), ts -> transform(ts, (t, i) -> {word}))), '')"
    pieces = "regexp_extract_all(l, '[•|:]+|[^•|:]+', 0)"
    line = f"array_join(transform({pieces}, p -> if(p rlike '^[•|:]', right(p, 1), array_join(transform(array({tr('p')}), g -> {stretch}), ''))), '')"
    whole = f"coalesce({column}, '')"
    changes = f"[•|:]|(?:^|{space})[^a-zA-Z{inner}]*+[A-Z][^a-z{inner}]*+(?:$|{space})"
    lines = f"split({tr(whole)}, '\\n')"
    plain = f"if(contains({whole}, '\n'), array_join(transform({lines}, l -> {tr('l')}), '\\n'), {tr(whole)})"
    # a capital that no small letter follows, or a separator, is seen far sooner
    likely = f"{whole} rlike '[A-Z](?![a-z])' or {whole} rlike '[•|:]'"
    return F.expr(f"if(({likely}) and {whole} rlike '{changes}', array_join(transform(transform({lines}, l -> {tr('l')}), l -> {line}), '\\n'), {plain})")


def section_slug(chapter: Column, title: Column, index: Column) -> Column:
    """``chapter-slug``; the slug of an empty title is its index, and an empty chapter has no slug at all."""
    slug = _replace(F.translate(F.lower(title), "", ""), ("[^a-z0-9]+", "-"), ("^-|-$", ""))
    slug = F.when(F.coalesce(title, F.lit("")) != "", slug).otherwise(F.concat(F.lit("section-"), index.cast("string")))
    return F.when(F.coalesce(chapter, F.lit("")) != "", F.concat(chapter, F.lit("-"), slug)).otherwise("")


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs without overlap, in any case, markup included. A blank term is no search: 0."""
    term = term.strip().lower()
    if not term:
        return F.lit(0)
    return F.size(F.split(F.lower(F.coalesce(text, F.lit(""))), quoted(term), -1)) - 1


def highlight(html: Column, query: str | None, keep_blanks: bool = False) -> Column:
    """Wrap every occurrence of the query outside tags in ``<mark>``. Queries are trimmed unless ``keep_blanks``."""
    term = (query or "") if keep_blanks else (query or "").strip()
    if not term.strip():
        return F.coalesce(html, F.lit(""))
    return F.array_join(F.transform(_around_tags(html), lambda p: F.when(F.startswith(p, F.lit("<")), p).otherwise(F.regexp_replace(p, F.lit(f"(?iu)({quoted(term)})"), F.lit("<mark>$1</mark>")))), "")


def _around_tags(html: Column) -> Column:
    """The text cut into tags and what is between them."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"<[^>]*>|<[^>]*$|[^<]+"), F.lit(0))


def link_terms(html: Column, terms: list[str]) -> Column:
    """Mark the terms, longest first and as whole words, outside tags; a link carries its match in lower case as key. The list
    becomes one pattern, so it should stay below some thousands of terms; operators.glossary.link_glossary has no such bound."""
    if not terms:
        return html
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    pattern = rf"(?i){BOUNDARY}(?:{'|'.join(quoted(t) for t in ordered)}){BOUNDARY}"

    def linked(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit(pattern), F.lit(0))
        marks = F.transform(found, lambda m: F.concat(F.lit('<span data-term="'), F.replace(F.replace(F.lower(m), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('">'), m, F.lit("</span>")))
        return F.array_join(F.zip_with(F.split(part, pattern, -1), F.concat(marks, F.array(F.lit(""))), lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit("")))), "")

    return F.array_join(F.transform(_around_tags(html), lambda p: F.when(F.startswith(p, F.lit("<")), p).otherwise(linked(p))), "")


def shown_html(html: Column, query: str | None, terms: list[str], is_glossary: Column) -> Column:
    """What a section shows: marks of a search if there is one, else glossary links, but none in the glossary itself."""
    if (query or "").strip():
        return highlight(html, query)
    return F.when(is_glossary, F.coalesce(html, F.lit(""))).otherwise(link_terms(html, terms))


def report_name(event: Column, suffix: str) -> Column:
    """First four words of letters and digits joined by ``_``, then the suffix; ``Report`` for an empty name."""
    kept = F.filter(F.split(trim(_replace(F.coalesce(event, F.lit("")), (r"[^A-Za-z0-9\s]", ""))), rf"{SPACE}+"), lambda w: w != "")
    name = F.array_join(F.slice(kept, 1, 4), "_")
    return F.concat(F.when(name != "", name).otherwise("Report"), F.lit(f"_{suffix}"))


def is_numeric_icon(icon: Column) -> Column:
    return F.coalesce(icon.rlike("^[0-9]+$"), F.lit(False))


def citation(kind: str, chapter: Column, icon: Column, section: Column, url: Column, accessed: Column) -> Column:
    """A formal, markdown or url citation; numbered chapters get ``Ch N - `` before their title."""
    title = F.concat(F.when(is_numeric_icon(icon), F.concat(F.lit("Ch "), icon, F.lit(" - "))).otherwise(""), chapter)
    if kind == "formal":
        return F.concat(title, F.lit(", "), section, F.lit(". Accessed "), F.date_format(accessed, "d MMMM yyyy"), F.lit(". "), url)
    if kind == "markdown":
        return F.concat(F.lit("["), title, F.lit(": "), section, F.lit("]("), url, F.lit(")"))
    if kind == "url":
        return url
    raise ValueError(f"no citation of kind {kind!r}")


def percent(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent with one decimal, half up; 0.0 for an empty total."""
    return F.format_string("%.1f", F.when(total > 0, 100.0 * part / total).otherwise(0.0))


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def encode_component(text: Column) -> Column:
    """Percent-encoding that leaves letters, digits and ``-_.!~*'()`` alone."""
    out = F.url_encode(text)
    for code, sign in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def decode_component(text: Column) -> Column:
    """The reverse; empty for malformed codes."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), F.lit(""))


def mailto(address: str, subject: Column, body: Column) -> Column:
    return F.concat(F.lit(f"mailto:{address}?subject="), encode_component(F.coalesce(blank_to_null(subject), F.lit("Suggestion"))), F.lit("&body="), encode_component(F.coalesce(body, F.lit(""))))


def stable_key(*columns: Column) -> Column:
    """Seven base-36 signs that depend on the columns only."""
    return F.lpad(F.lower(F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *columns), 256), 1, 9), 16, 36)), 7, "0").substr(1, 7)


def has_keyword(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether any keyword occurs: those of letters and digits as whole words, others anywhere."""
    plain = [k for k in keywords if re.fullmatch("[A-Za-z0-9]+", k)]
    other = tuple(k for k in keywords if k not in plain)
    whole = [rf"(?<![A-Za-z0-9_])(?i:{'|'.join(plain)})(?![A-Za-z0-9_])"] if plain else []
    return text.rlike("|".join([*whole, *([any_of(other)] if other else [])]) or "(?!)")
