"""Column builders for text: folding, matched spans, masks and splits. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters beyond ASCII; folding writes x for each, so that ASCII word boundaries hold and offsets stay.
FOREIGN_LETTER = r"[^\x00-\x7F\P{L}]"
CODE = r"(?ms)(?:^`{3,}[^\n]*\n.*?^`{3,}[ \t]*$|^~{3,}[^\n]*\n.*?^~{3,}[ \t]*$|`[^`\n]*`)"
QUOTED = r'"[^"\n]*"|\'[^\'\n]*\'|“[^”\n]*”|‘[^’\n]*’'
#: Headings, table rows and block quotes, which are no prose.
NO_PROSE_LINES = r"(?m)^(?:#{1,6}[ \t]+[^\n]+|[ \t]*\|[^\n]*\|[ \t]*|>[^\n]*)$"
SENTENCE_END = r"[.!?]+(?:\s+|\z)"
PARAGRAPH_END = r"\n[ \t]*\n"
WORD = r"[A-Za-z0-9']+"


#: Signs that are set around a match, so that one pass of a pattern cuts a text; they stand for no letter of any script.
OPEN, CLOSE = "\uFDD0", "\uFDD1"
#: Offsets are summed in blocks of this many matches, then over the blocks, so that the work grows with the matches.
BLOCK = 32


def quick(pattern: str) -> str:
    """``pattern`` for Spark with the ASCII ranges of its classes written out: Java looks listed signs up in one table, but asks
    one range after the other. What it matches stays the same; other engines take patterns as they are."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern.index("}", i) + 1 - i if pattern[i + 2 : i + 3] == "{" and pattern[i + 1] in "pPx" else 4 if pattern[i + 1] == "x" else 2
            out.append(pattern[i : i + n])
            i += n
            continue
        if inside and c.isascii() and c.isalnum() and pattern[i + 1 : i + 2] == "-" and (last := pattern[i + 2]).isascii() and last.isalnum():
            out.append("".join(map(chr, range(ord(c), ord(last) + 1))))
            i += 3
            continue
        if not inside and c == "[":
            inside, n = True, 2 if pattern[i + 1] == "^" else 1
            # A bracket that comes first is a sign of its class
            n += pattern[i + n] == "]"
            out.append(pattern[i : i + n])
            i += n
            continue
        inside = inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def beginning(heads: str, pattern: str) -> str:
    """``pattern``, whose matches begin with one of the letters or digits ``heads`` in either case: a cheap look at each place."""
    letters = "".join(sorted({*heads.lower(), *heads.upper()}))
    return f"(?=[{letters}]){pattern}" if heads else pattern


def folded(text: Column) -> Column:
    """``text`` with an x for each letter beyond ASCII; a text that is all ASCII is left alone."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(text, FOREIGN_LETTER, "x"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def literal(value: str) -> str:
    """A string in the words of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def unmarked(text: Column) -> Column:
    """``text`` with its own signs that ``pieces`` would take for marks replaced; offsets stay."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, "\uFFFD\uFFFD")).otherwise(text)


def pieces(text: Column, pattern: str) -> Column:
    """The text before the first match; then, of each match, what matched, CLOSE, and the text up to the next one."""
    return F.split(F.regexp_replace(unmarked(text), F.lit(quick(pattern)), F.lit(OPEN + "$0" + CLOSE)), OPEN, -1)


#: Of each piece how long the match is (0 of the first) and the text after it.
_LENGTHS = f"transform(%s, (p, i) -> if(i = 0, named_struct('h', 0, 'g', length(p)), named_struct('h', length(substring_index(p, '{CLOSE}', 1)), 'g', length(p) - length(substring_index(p, '{CLOSE}', 1)) - 1)))"


def lengths_sql(text: str, pattern: str) -> str:
    """The lengths of the pieces of an ``unmarked`` column, in the words of SQL, which are quick to make for many patterns."""
    return _LENGTHS % f"split(regexp_replace({text}, {literal(quick(pattern))}, '{OPEN}$0{CLOSE}'), '{OPEN}', -1)"


def lengths(cut: Column) -> Column:
    def told(p: Column, i: Column) -> Column:
        hit = F.when(i == 0, 0).otherwise(F.length(F.substring_index(p, CLOSE, 1)))
        return F.struct(hit.alias("h"), (F.length(p) - hit - F.when(i == 0, 0).otherwise(1)).alias("g"))

    return F.transform(cut, told)


def placed(lens: Column) -> Column:
    """Array of (start, end) of the matches, in code points, from the ``lengths`` of a text's pieces."""
    place = "struct<start:int,end:int>"

    def step(acc, x):
        end = acc["at"] + x["h"]
        return F.struct((end + x["g"]).alias("at"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("found"))

    def summed(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{place}>").alias("found")), step)

    def moved(x: Column, base: Column) -> Column:
        return F.transform(x["found"], lambda f: F.struct((f["start"] + base).alias("start"), (f["end"] + base).alias("end")))

    def joined(done: Column) -> Column:
        bases = F.aggregate(done, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(done, F.slice(bases, F.lit(1), F.size(done)), moved))

    def whole(lens: Column) -> Column:
        last = F.floor((F.size(lens) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: summed(F.slice(lens, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(lens) > 1, F.slice(let(blocks, joined), F.lit(2), F.size(lens) - 1)).when(lens.isNotNull(), F.array().cast(f"array<{place}>"))

    return let(lens, whole)


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of a pattern's matches, in code points. The pattern must not match the empty string."""

    def told(p: Column, at: Column) -> Column:
        return F.struct(at["start"].alias("start"), at["end"].alias("end"), F.substring_index(p, CLOSE, 1).alias("value"))

    cut = pieces(text, pattern)
    return let(cut, lambda c: F.zip_with(F.slice(c, F.lit(2), F.size(c)), placed(lengths(c)), told))


_PLACES = "array<struct<start:int,end:int>>"
_SUMMED = f"aggregate(slice(l, b * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'found', cast(array() as {_PLACES})), (a, x) -> named_struct('at', a.at + x.h + x.g, 'found', concat(a.found, array(named_struct('start', a.at, 'end', a.at + x.h)))))"
_BASES = "slice(aggregate(d, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x.at))), 1, size(d))"
_MOVED = f"zip_with(d, {_BASES}, (x, y) -> transform(x.found, f -> named_struct('start', f.start + y, 'end', f.end + y)))"
_WHOLE = f"transform(array(transform(sequence(0, cast(floor((size(l) - 1) / {BLOCK}) as int)), b -> {_SUMMED})), d -> flatten({_MOVED}))[0]"
_SPANS = f"transform(array(split(%s, '{OPEN}', -1)), c -> zip_with(slice(c, 2, size(c)), transform(array({_LENGTHS % 'c'}), l -> if(size(l) > 1, slice({_WHOLE}, 2, size(l) - 1), cast(array() as {_PLACES})))[0], (p, at) -> named_struct('start', at.start, 'end', at.end, 'value', substring_index(p, '{CLOSE}', 1))))[0]"


def spans_sql(text: str, pattern: str) -> str:
    """``spans`` of an ``unmarked`` column, in the words of SQL: a hundred patterns are made in the time of one by columns."""
    return _SPANS % f"regexp_replace({text}, {literal(quick(pattern))}, '{OPEN}$0{CLOSE}')"


#: Characters of a part of a text that values are cut from.
PART = 1024


def parts(text: Column) -> Column:
    """A text in parts of PART characters, so that a value is cut without counting from the text's start."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PART).cast("int")), lambda i: F.substring(text, i * PART + 1, F.lit(PART)))


def taken(held: Column, start: Column, n: Column) -> Column:
    """``n`` characters from ``start`` on of a text that is held in ``parts``."""
    first = F.floor(start / PART).cast("int")
    last = F.floor((start + F.greatest(n, F.lit(1)) - 1) / PART).cast("int")
    return F.substring(F.array_join(F.slice(held, first + 1, last - first + 1), ""), start - first * PART + 1, n)


def any_word(words: list[str]) -> str:
    """A pattern of whole lower-case words (letters, digits, underscores)."""
    heads = "".join(sorted({w[0] for w in words}))
    return quick(f"(?=[{heads}])(?<![a-z0-9_]){branching(words)}(?![a-z0-9_])")


def branching(words: list[str]) -> str:
    """A pattern of words that branch letter by letter, so that a place where none begins is left at once, however many there
    are. The longest that fits is found, so what comes after it in a pattern should tell where a word ends."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[0], []).append(w[1:])
    told = [head + (branching([t for t in tails if t]) + "?" * ("" in tails) if any(tails) else "") for head, tails in heads.items()]
    return "(?:" + "|".join(told) + ")"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(quick(pattern)))


def masked(text: Column, pattern: str, needles: tuple[str, ...] = ()) -> Column:
    """Matches replaced by as many spaces, so that offsets survive; a text without any of ``needles`` has none."""

    def blank(p: Column, i: Column) -> Column:
        hit = F.length(F.substring_index(p, CLOSE, 1))
        return F.when(i == 0, p).otherwise(F.concat(F.repeat(F.lit(" "), hit), F.substring(p, hit + 2, F.length(p))))

    done = F.array_join(F.transform(pieces(text, pattern), blank), "")
    return F.when(any_in(text, needles), done).otherwise(text) if needles else done


def any_in(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether a text holds one of some strings: a cheap test before a pattern."""
    held = F.lit(False)
    for needle in needles:
        held = held | F.contains(text, F.lit(needle))
    return held


def mask_code(text: Column) -> Column:
    return masked(text, CODE, ("`", "~~~"))


def mask_quotes(text: Column) -> Column:
    return masked(text, QUOTED, ('"', "'", "“", "‘"))


def mask_code_and_quotes(text: Column) -> Column:
    return mask_quotes(mask_code(text))


def mask_no_prose(text: Column) -> Column:
    """Headings, tables and block quotes blanked."""
    return masked(text, NO_PROSE_LINES, ("#", "|", ">"))


def mask_prose(text: Column) -> Column:
    """Code, headings, tables and block quotes blanked."""
    return mask_no_prose(mask_code(text))


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return count_of(text, r"[^\s]+")


def sentences(text: Column) -> Column:
    """Trimmed sentences that are not empty, without the marks that end them."""
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_END, -1), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(quick(WORD)), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words_of(F.lower(text)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(F.transform(values, lambda x: x.cast("double"))) / F.size(values))


def variation(values: Column) -> Column:
    """Population standard deviation over mean; null without values or with a mean of 0."""
    m = mean(values)
    squares = total(F.transform(values, lambda x: x.cast("double") * x.cast("double")))
    deviation = F.sqrt(F.greatest(F.lit(0.0), squares / F.size(values) - m * m))
    return F.when(m > 0, deviation / m)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones score 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
