"""Text columns: name normalisation, strict numbers, identifier parts, hashes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space, and the four ASCII separators.
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
           "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Unicode's full case folding by rule: characters that fold to one other, these others, and characters that fold to several."""
    folds = {ch: f for ch in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (f := ch.casefold()) != ch}
    one = {ch: f for ch, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {ch: f for ch, f in folds.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Full case folding. ASCII text needs none of the tables, and only text with a character that folds to several goes through these."""
    one, to, several = _folds()
    pairs = F.array(*[F.struct(F.lit(ch).alias("of"), F.lit(f).alias("to")) for ch, f in several.items()])
    longer = F.aggregate(pairs, c, lambda acc, p: F.replace(acc, p["of"], p["to"]))
    folded = F.translate(F.when(c.rlike(f"[{''.join(several)}]"), longer).otherwise(c), one, to)
    return F.when(c.rlike("[^\\x00-\\x7F]"), folded).otherwise(F.lower(c))


def norm_name(c: Column) -> Column:
    """Trim, collapse white space, fold case. An empty name is NULL, never an empty identifier."""
    return F.nullif(casefold(strip(F.regexp_replace(c, f"[{_BLANKS}]+", " "))), F.lit(""))


def has_edge_space(c: Column) -> Column:
    return c != strip(c)


def weight_status(c: Column) -> Column:
    """OK | EMPTY | NOT_INTEGER for a verbatim weight."""
    text = strip(F.coalesce(c, F.lit("")))
    return (F.when(text == "", "EMPTY")
            .when(text.rlike("^[0-9]+$") & text.try_cast("bigint").isNotNull(), "OK")
            .otherwise("NOT_INTEGER"))


def weight_grams(c: Column) -> Column:
    """Whole grams where `weight_status` is OK, else NULL."""
    return F.when(weight_status(c) == "OK", strip(c).try_cast("bigint"))


def scale_parts(c: Column, kinds: Sequence[str]) -> dict[str, Column]:
    """line, side, kind and position of `line-side-kindN` or `line-kindN`; what does not parse is NULL."""
    parts = F.split(strip(c), "-")
    n = F.size(parts)
    last = F.when(n.isin(2, 3), F.element_at(parts, -1))
    pattern = f"^({'|'.join(map(re.escape, kinds))})([0-9]+)$"
    return {
        "line": F.nullif(F.get(parts, F.lit(0)), F.lit("")),
        "side": F.when(n == 3, F.get(parts, F.lit(1))),
        "kind": F.nullif(F.regexp_extract(last, pattern, 1), F.lit("")),
        "position": F.nullif(F.regexp_extract(last, pattern, 2), F.lit("")).try_cast("int"),
    }


def station_family(c: Column) -> Column:
    return F.when(c != "", F.split_part(c, F.lit("-"), F.lit(1)))


def scale_kind_label(c: Column, kinds: Sequence[tuple[str, str]]) -> Column:
    """Label of the first kind whose word the identifier holds."""
    return F.coalesce(*[F.when(c.contains(word), label) for word, label in kinds], F.lit("other"))


def digit_mask(c: Column) -> Column:
    """Every digit as 9: the shape of a value."""
    return F.regexp_replace(c, "[0-9]", "9")


def collapse_twin(c: Column, sides: Sequence[str]) -> Column:
    """Twin scales, told apart by a word for their side, as one."""
    return F.regexp_replace(c, f"-({'|'.join(map(re.escape, sides))})-", "-X-")


def id_number(c: Column) -> Column:
    """First run of digits in an identifier."""
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("bigint")


def row_hash(cells: list[Column]) -> Column:
    """Hash of the verbatim cells; a NULL cell counts as empty text."""
    return F.sha2(F.concat_ws(chr(31), *[F.coalesce(c, F.lit("")) for c in cells]), 256)


def finding_id(rule: Column, entity_type: Column, entity: Column) -> Column:
    """Same finding on the same entity, same id: the whole hash, so that different findings do not meet however many there are."""
    return F.concat(F.lit("vi-"), F.sha2(F.concat_ws("|", rule, entity_type, entity), 256))


def population_of(file_name: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Population by prefix of the file's own name. A file that matches no rule, or several, stops the job."""
    file_name = F.element_at(F.split(file_name, "/"), -1)
    matches = sum((F.startswith(file_name, F.lit(prefix)).cast("int") for prefix, _ in rules), F.lit(0))
    ladder = F.when(matches != 1, F.raise_error(F.concat(F.lit("file matches no single population rule: "), file_name)))
    for prefix, population in rules:
        ladder = ladder.when(F.startswith(file_name, F.lit(prefix)), F.lit(population))
    return ladder
