"""Positions of pattern matches in a text, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many matches are placed at once.
CHUNK = 256
SPAN = "struct<kind: string, start: int, stop: int, found: string>"


def find(df: DataFrame, patterns: dict[str, str], guards: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """Add an array column for each name of ``patterns``: all leftmost non-overlapping matches in ``df[text]``.

    A match is (kind, start, stop, found), positions in code points, stop exclusive. Matches come from one scan, the
    stretches between them from another where there are any, and their lengths add up to the positions. The sums are
    taken in two levels, over chunks of matches and inside each, so that a text of very many matches isn't copied once
    for each of them. A guard is a string without which the pattern has no match. Patterns must not match the empty
    string; the text must not be null.
    """
    guards = guards or {}
    none = F.array().cast("array<string>")
    scan = lambda p: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
    df = df.withColumns({f"_{n}": F.when(F.contains(F.col(text), F.lit(guards[n])), scan(p)).otherwise(none) if n in guards else scan(p) for n, p in patterns.items()})
    return df.withColumns({n: F.when(F.size(f"_{n}") > 0, F.expr(_placed(n, p, text))).otherwise(F.array().cast(f"array<{SPAN}>")) for n, p in patterns.items()}).drop(*[f"_{n}" for n in patterns])


def _placed(name: str, pattern: str, text: str) -> str:
    """SQL of the spans of the matches in ``_name``. ``transform(array(x), y -> ...)[0]`` gives x, worked out once, a name."""
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = f"zip_with(slice(split({text}, {quoted}, -1), 1, size(_{name})), _{name}, (g, f) -> named_struct('gap', char_length(g), 'size', char_length(f), 'found', f))"
    chunks = f"transform(array({pairs}), p -> transform(sequence(0, (size(p) - 1) div {CHUNK}), c -> slice(p, c * {CHUNK} + 1, {CHUNK})))[0]"
    before = "aggregate(slice(ch, 1, size(ch) - 1), array(0), (t, m) -> concat(t, array(element_at(t, -1) + aggregate(m, 0, (n, x) -> n + x.gap + x.size))))"
    inside = f"""aggregate(m, named_struct('at', b[c], 'spans', cast(array() as array<{SPAN}>)),
        (s, x) -> named_struct('at', s.at + x.gap + x.size, 'spans', concat(s.spans, array(named_struct('kind', '{name}', 'start', s.at + x.gap, 'stop', s.at + x.gap + x.size, 'found', x.found)))), s -> s.spans)"""
    return f"transform(array({chunks}), ch -> transform(array({before}), b -> flatten(transform(ch, (m, c) -> {inside})))[0])[0]"


def joined(spans: str, order: tuple[str, ...]) -> Column:
    """kind:start:stop of each span of the array column, by start, then by the order of kinds, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in order)
    return F.expr(f"array_join(transform(array_sort(transform({spans}, s -> named_struct('start', s.start, 'place', array_position(array({kinds}), s.kind), 'stop', s.stop, 'kind', s.kind))), s -> concat_ws(':', s.kind, s.start, s.stop)), ',')")


def count(spans: str, kind: str) -> Column:
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = '{kind}')) as bigint)")
