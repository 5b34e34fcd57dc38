"""Text columns: whitespace, case, match keys and slugs, all as JVM expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from string import ascii_lowercase, digits

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode blanks, written as a regular-expression class.
BLANKS = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# The same runs without single spaces, which stay as they are and are most of them. Visible ascii characters,
# most of a text, are told by one range: a class asks each of its ranges in turn.
RUNS = f"(?![!-~])(?:(?! ){BLANKS[:-1]}| (?={BLANKS[:-1]})){BLANKS[:-1]}*"
CASED = r"[\p{IsUppercase}\p{IsLowercase}\p{Lt}]"


def _ascii(char: str) -> str:
    return unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()


@lru_cache(maxsize=1)
def _folded() -> list[tuple[str, str]]:
    """Every character beyond ascii that folds to ascii characters, and these."""
    pairs = [(chr(c), _ascii(chr(c))) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    return [(a, b) for a, b in pairs if b]


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """The characters that fold to exactly one ascii character."""
    single = [(a, b) for a, b in _folded() if len(b) == 1]
    return "".join(a for a, _ in single), "".join(b for _, b in single)


#: Ranges of characters in a block of `_expanding`.
BLOCK = 9


@lru_cache(maxsize=1)
def _expanding() -> tuple[str, str]:
    """The characters that fold to several: as a regular expression, and as text of a map.

    The ranges of characters come in blocks, so a character is held against the blocks and the ranges of one.
    """
    several = [(a, b) for a, b in _folded() if len(b) > 1]
    codes = [ord(a) for a, _ in several]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    ranges = [(f"\\x{{{a:x}}}", f"\\x{{{b:x}}}") for a, b in zip(starts, ends, strict=True)]
    blocks = [ranges[i:i + BLOCK] for i in range(0, len(ranges), BLOCK)]
    listed = "|".join(f"(?=[{b[0][0]}-{b[-1][1]}])[{''.join(f'{x}-{y}' for x, y in b)}]" for b in blocks)
    return f"(?![\\x00-\\x7F])(?:{listed})", "\x01".join(f"{a}\x02{b}" for a, b in several)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_text(col: Column, title: bool = False) -> Column:
    """Null to blank, runs of blanks to one space, trimmed; optionally in title case."""
    cleaned = F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), RUNS, " "))
    return title_case(cleaned) if title else cleaned


def title_case(col: Column) -> Column:
    """Upper case for each letter that follows a non-letter, lower case elsewhere."""
    def word(w: Column) -> Column:
        first = F.upper(F.left(w, F.lit(1)))  # may be two letters, as for a sharp s
        return F.concat(F.left(first, F.lit(1)), F.lower(F.substr(first, F.lit(2))), F.lower(F.substr(w, F.lit(2))))

    return F.array_join(F.transform(F.split(col, f"(?<=[^{CASED[1:-1]}])"), word), "")


#: Bytes of text that are decomposed at once.
SLICE = 1 << 20


@F.arrow_udf(T.StringType())
def _fold_wide(values: pa.Array) -> pa.Array:
    """Batches come by rows, whatever their length, so only a slice of one is held as Python strings."""
    done, start, size = [], 0, 0
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    for end, length in enumerate(lengths, 1):
        size += int(length)
        if size >= SLICE or end == len(values):
            texts = values.slice(start, end - start).to_pylist()
            folded = [t if t is None or t.isascii() else _ascii(t) for t in texts]
            done.append(pa.array(folded, pa.string()))
            start, size = end, 0
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def fold_ascii(col: Column, wide: bool = False) -> Column:
    """Compatibility decomposition to ascii; what has no ascii form is dropped.

    The default stays in the JVM; `wide` works in Arrow batches. Characters fold one by one, so both
    agree. Those that expand are looked up only in values that hold one.
    """
    return _fold_wide(col) if wide else once(col, _fold)


def _fold(col: Column) -> Column:
    source, target = _folding()
    several, table = _expanding()
    letters = F.str_to_map(F.lit(table), F.lit("\x01"), F.lit("\x02"))
    expanded = F.array_join(F.transform(F.split(col, ""), lambda c: F.when(c > "\x7f", F.coalesce(letters[c], c)).otherwise(c)), "")
    expanded = F.when(col.rlike(several), expanded).otherwise(col)
    folded = F.regexp_replace(F.translate(expanded, source, target), r"[^\x00-\x7F]", "")
    return F.when(col.rlike(r"[^\x00-\x7F]"), folded).otherwise(col)


def match_key(col: Column, wide: bool = False) -> Column:
    """Join key: trimmed, lower case, accents folded, blanks collapsed."""
    lowered = F.lower(clean_text(col))
    return F.trim(F.regexp_replace(fold_ascii(lowered, wide), RUNS, " "))


def slug(col: Column, wide: bool = False) -> Column:
    return key_slug(match_key(col, wide))


def key_slug(key: Column) -> Column:
    return F.trim(F.regexp_replace(key, f"[^{digits}{ascii_lowercase}]+", "_"), F.lit("_"))


def non_blank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) != ""


def pick_non_blank(first: Column, second: Column) -> Column:
    """`first` where it holds text, otherwise `second`."""
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(second)


def same_name(col: Column, name: str) -> Column:
    return F.lower(col) == F.lower(F.lit(name))


def named_like(col: Column, fragments: list[str]) -> Column:
    """True where the lower-case name contains any of the fragments."""
    return F.lower(col).rlike("|".join(fragments))
