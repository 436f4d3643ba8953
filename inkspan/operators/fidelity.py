"""Fidelity of a candidate to its source: protected spans by priority, semantic anchors, aligned changes, churn, permissions, gate.

Spans are found by patterns inside the JVM. Two small Arrow helpers work on numbers and keys of a row: the choice of spans that
do not overlap, and the alignment of two sequences. Changes then are rows, which joins and sums judge.
"""

from __future__ import annotations

import difflib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import alignment
from ..functions import text as T
from ..functions.workers import importable

# Word characters and white space as Unicode has them, in the words of Java's patterns
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_REST = rf"[^{_SPACE}<>\"']+"
_PART = r"[A-Za-z0-9_.\-]"
_NO_PART, _NO_ALNUM = r"(?<![A-Za-z0-9_.\-])", r"(?<![A-Za-z0-9])"
_D = r"\p{Nd}"

# Months, units, words of anchors, and what protected spans look like. A look at the first sign comes first, and what
# looks behind is asked once for all the alternatives that need it
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
UNITS = """ms sec secs second seconds millisecond milliseconds microsecond microseconds nanosecond nanoseconds min mins minute minutes
hr hrs hour hours day days week weeks month months yr yrs year years kb mb gb tb pb bit bits byte bytes kib mib gib tib bps kbps
mbps gbps tbps hz khz mhz ghz thz px em rem vh vw vmin vmax dpi ppi usd eur gbp aud cad jpy cm mm km mi mile miles ft foot feet
inch inches mph kmh kg mg g lb lbs oz qps rps tps rpm percent percentage""".split()
PROTECTED = {
    "code_block": r"(?ms)^`{3,}[^\n]*\n.*?^`{3,}[ \t]*$|^~{3,}[^\n]*\n.*?^~{3,}[ \t]*$",
    "quoted": r"""(?=["'“‘`])(?:"[^"\n]*"|'[^'\n]*'|“[^”\n]*”|‘[^’\n]*’|`[^`\n]*`)""",
    "url": rf"(?=[hfw]){_B}(?:https?://{_REST}|ftp://{_REST}|www\.[A-Za-z0-9_.\-]+)",
    "path": rf"{_NO_PART}(?={_PART}*+/)(?:(?:{_PART}++/){{2,}}{_PART}*(?:/[^{_SPACE}<>\"']*)?|/(?:{_PART}++/)*{_PART}+|(?!(?:and|or|either)/)(?:{_PART}++/)+{_PART}+)|\./{_REST}|~/{_REST}|(?=[A-Za-z]:){_B}[A-Za-z]:[\\/]{_REST}",
    "required_term": "",
    "date": rf"(?=[{_D}{''.join(sorted({m[0] for m in MONTHS.split('|')}))}]){_NO_ALNUM}(?:{_D}{{4}}[-/]{_D}{{1,2}}[-/]{_D}{{1,2}}|{_D}{{1,2}}[-/]{_D}{{1,2}}[-/]{_D}{{2,4}}|(?:{MONTHS})[a-z]*[{_SPACE}]+{_D}{{1,2}}(?:st|nd|rd|th)?,?[{_SPACE}]+{_D}{{4}}|{_D}{{1,2}}(?:st|nd|rd|th)?[{_SPACE}]+(?:{MONTHS})[a-z]*[{_SPACE}]+{_D}{{4}})(?![A-Za-z0-9])",
    "unit": rf"(?i)(?<![A-Za-z]){T.branching(UNITS)}(?![A-Za-z])",
    "number": rf"(?<![A-Za-z0-9.]){_D}+(?:,{_D}{{3}})*(?:\.{_D}+)?%?",
    "operator": rf"(?=[<>!=&|+*/-])(?:<=|>=|!=|==|&&|\|\||[+*/]|(?<={_D})-(?={_D}))",
}
_WORDS = {
    "negation": "not no never none nobody nothing nowhere without neither nor isn't isnt aren't arent wasn't wasnt weren't werent don't dont doesn't doesnt didn't didnt can't cant cannot won't wont wouldn't wouldnt couldn't couldnt shouldn't shouldnt mustn't mustnt hasn't hasnt haven't havent hadn't hadnt".split(),
    "polarity": "increase increases increased increasing decrease decreases decreased decreasing rise rises rose rising fall falls fell falling grow grows grew growing shrink shrinks shrank shrinking reduce reduces reduced reducing cut cuts cutting double doubles doubled doubling improve improves improved improving worsen worsens worsened worsening positive negative more less higher lower greater fewer".split(),
    "modality": ["may", "might", "can", "could", "will", "would", "shall", "should", "must", "ought", "need to", "have to", "has to"],
    "quantifier": ["all", "some", "any", "every", "each", "many", "most", "few", "several", "none", "both", "neither", "plenty", "at least", "at most", "no more than", "no less than", "up to", "over", "under", "more than", "less than"],
    "causality": ["because", "therefore", "thus", "hence", "consequently", "leads? to", "led to", "results? in", "results? from", "caused", "causes", "causing", "cause", "so that"],
    "condition": ["if", "unless", "provided that", "as long as", "given that", "assuming", "whenever"],
    "scope": ["up to", "at most", "no more than", "at least", "no less than", "approximately", "about", "roughly", "nearly", "more than", "less than", "over", "under", "within", "exactly"],
}
_NAMED, _SECOND = r"[A-Z][A-Za-z0-9']+", rf"(?:[{_SPACE}]+[A-Z][A-Za-z0-9']+)?"
# A look at the first letter comes before what looks behind
ANCHORS = {name: (f"(?=[{''.join(sorted({w[0] for w in words}))}]){_B}(?:{'|'.join(words)}){_E}",) for name, words in _WORDS.items()} | {
    "attribution": tuple(rf"(?=[Aarp]){_B}{head}[{_SPACE}]+{_NAMED}{_SECOND}" for head in ("[Aa]ccording to", "reported by", "per")) + (rf"(?=[A-Z]){_B}{_NAMED}[{_SPACE}]+(?:said|reported|stated|claimed|argued|wrote|noted|highlighted)",),
    "name": (rf"(?=[A-Z]){_B}[A-Z]{{2,}}(?:[0-9]+)?{_E}",),
}
#: Categories whose changes a person looks at; changes of others fail.
REVIEWED = ("attribution", "name")
#: Cells that the bounded ``opcodes`` may compare; longer sequences are compared in linear time. Queries align whole sequences.
MOST_CELLS = 1_000_000
CHURN_LIMIT, CHURN_MULTIPLIER = 0.5, 3.0

def canonical(category: str, value: str) -> str:
    """How values of a category are compared: numbers without signs and commas, dates with dashes, units in lower case, the rest as they are."""
    if category == "number":
        return f"regexp_replace({value}, '[%,]', '')"
    if category == "date":
        return f"btrim(regexp_replace(regexp_replace(lower({value}), '[,./]', '-'), {T.literal(chr(92) + 's+')}, ' '))"
    return f"lower({value})" if category == "unit" else value


#: What a text must hold, in the words of SQL, to be searched for spans of a category: one cheap look before its pattern.
_DIGIT = "regexp_like(%s, '[0-9]|[^\\\\x00-\\\\x7F]')"
LIKELY = {
    "code_block": "contains(%s, '```') OR contains(%s, '~~~')",
    "url": "contains(%s, '://') OR contains(%s, 'www.')",
    "path": r"contains(%s, '/') OR contains(%s, ':\\')",
    "date": _DIGIT,
    "number": _DIGIT,
}
_NONE = "cast(array() as array<struct<start:int,end:int,value:string>>)"
_NO_ANCHORS = "cast(array() as array<struct<category:string,start:int,end:int,value:string,canonical:string>>)"


def _of(text: str, category: str, pattern: str) -> str:
    told = f"named_struct('category', '{category}', 'start', s.start, 'end', s.end, 'value', s.value, 'canonical', {canonical(category, 's.value')})"
    spans = T.spans_sql(text, pattern)
    if category in LIKELY:
        spans = f"if({LIKELY[category].replace('%s', text)}, {spans}, {_NONE})"
    return f"transform({spans}, s -> {told})"


def ordered(spans: str) -> str:
    return f"array_sort({spans}, (a, b) -> CASE WHEN a.start < b.start OR (a.start = b.start AND a.end < b.end) THEN -1 WHEN a.start = b.start AND a.end = b.end THEN 0 ELSE 1 END)"


def protected_candidates(text: str, terms: tuple[str, ...] = ()) -> str:
    """All matches of the nine categories, by priority, then start and end; they may overlap. In the words of SQL, as are anchors."""
    quoted = lambda t: "".join("\\" + c if not c.isalnum() and c.isascii() and c != " " else c for c in t)
    wanted = [_of(text, "required_term", rf"(?iu)(?={quoted(t)}){_B}{quoted(t)}{_E}") for t in terms if t]
    found = [_of(text, category, pattern) for category, pattern in PROTECTED.items() if pattern]
    if wanted:
        found.insert(list(PROTECTED).index("required_term"), ordered(f"concat({', '.join(wanted)})"))
    return f"concat({', '.join(found)})"


def anchor_candidates(text: str) -> str:
    """All matches of the anchor categories; what two patterns of one category find at one place counts once."""
    return f"array_distinct(concat({', '.join(_of(text, category, p) for category, patterns in ANCHORS.items() for p in patterns)}))"


def helper(kind):
    """An Arrow helper that stays a step of its own, so that what it gives is not worked out anew wherever it is named."""
    return lambda f: F.pandas_udf(f, kind).asNondeterministic()


@helper(StructType([StructField(name, ArrayType(IntegerType())) for name in ("protected", "anchors")]))
def _chosen(size: pd.Series, starts: pd.Series, ends: pd.Series, anchor_starts: pd.Series, anchor_ends: pd.Series) -> pd.DataFrame:
    """Numbers of the spans, given by priority, that overlap none chosen before; and of the anchors that overlap none of them.

    What is chosen is marked on the text's places, so the work is that of the spans' lengths.
    """
    out = []
    for n, a, b, c, d in zip(size, starts, ends, anchor_starts, anchor_ends, strict=True):
        taken, kept = bytearray(n), []
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if 1 not in taken[x:y]:
                taken[x:y] = b"\x01" * (y - x)
                kept.append(i)
        out.append((kept, [i for i, (x, y) in enumerate(zip(c, d, strict=True)) if 1 not in taken[x:y]]))
    return pd.DataFrame(out, columns=["protected", "anchors"])


def extracted(rows: DataFrame, columns: dict[str, str], terms: tuple[str, ...] = (), anchored: bool = True) -> DataFrame:
    """``rows`` with, for each text column, an array of its protected spans and of its anchors, named by its prefix.

    Protected spans do not overlap: a span gives way to one of an earlier category, or of its own category and an earlier
    start. Anchors that overlap a protected span are left out. Both are ordered by start. A null text is the empty one. Unless
    ``anchored``, anchors are not looked for, which is much of the work.
    """
    importable(rows.sparkSession)
    found = rows
    for column, prefix in columns.items():
        p, a, c, text = f"{prefix}_p", f"{prefix}_a", f"{prefix}_c", f"{prefix}_text"
        found = found.withColumn(text, T.unmarked(F.coalesce(F.col(column), F.lit(""))))
        found = found.withColumns({p: F.expr(protected_candidates(text, terms)), a: F.expr(anchor_candidates(text) if anchored else _NO_ANCHORS)})
        at = lambda name, field: F.expr(f"transform({name}, s -> s.{field})")
        found = found.withColumn(c, _chosen(F.length(text), at(p, "start"), at(p, "end"), at(a, "start"), at(a, "end")))
        kept = lambda name, field: F.expr(ordered(f"transform({c}.{field}, i -> get({name}, i))"))  # noqa: E731, B023
        found = found.withColumns({p: kept(p, "protected"), a: kept(a, "anchors")}).drop(c, text)
    return found


def protected_spans(docs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, category, start_pos, end_pos, value, canonical) of each document's protected spans."""
    return _told(extracted(docs.select("doc_id", "text"), {"text": "s"}, terms), "s_p")


def semantic_anchors(docs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    return _told(extracted(docs.select("doc_id", "text"), {"text": "s"}, terms), "s_a")


def _told(found: DataFrame, name: str) -> DataFrame:
    told = found.select("doc_id", F.explode(name).alias("s"))
    return told.select("doc_id", "s.category", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"), "s.value", "s.canonical")


def opcodes(a: list, b: list, most_cells: int = MOST_CELLS) -> list[tuple[str, int, int, int, int]]:
    """What turns ``a`` into ``b`` within a bound of work, as the reference tells it: longest common stretches first.

    No query uses it: what it tells depends on the size. ``alignment.opcodes`` tells longest stretches of any size. Beyond ``most_cells`` pairs of items the work is linear: place by place if the lengths are equal, else what is between the
    common start and the common end is replaced.
    """
    if a == b:
        return [("equal", 0, len(a), 0, len(b))] if a else []
    if len(a) * len(b) <= most_cells:
        return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    if len(a) == len(b):
        turns = [i for i in range(len(a)) if not i or (a[i] == b[i]) != (a[i - 1] == b[i - 1])]
        return [("equal" if a[x] == b[x] else "replace", x, y, x, y) for x, y in zip(turns, [*turns[1:], len(a)], strict=True)]
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    room = min(len(a), len(b)) - head
    tail = next((i for i in range(room) if a[-1 - i] != b[-1 - i]), room)
    x, y = len(a) - tail, len(b) - tail
    middle = "insert" if x == head else "delete" if y == head else "replace"
    told = [("equal", 0, head, 0, head), (middle, head, x, head, y), ("equal", x, len(a), y, len(b))]
    return [t for t in told if t[1] < t[2] or t[3] < t[4]]


@helper(ArrayType(ArrayType(IntegerType())))
def _unequal(source_kinds: pd.Series, source_keys: pd.Series, candidate_kinds: pd.Series, candidate_keys: pd.Series) -> pd.Series:
    """(place in the source, place in the candidate) of what does not align, -1 on the side that has none, kind by kind."""
    out = []
    for own in zip(source_kinds, source_keys, candidate_kinds, candidate_keys, strict=True):
        sides = []
        for kinds, keys in (own[:2], own[2:]):
            places = defaultdict(list)
            for i, kind in enumerate(kinds):
                places[kind].append(i)
            sides.append((places, keys))
        (left, a), (right, b) = sides
        row = []
        for kind in left.keys() | right.keys():
            s, c = left.get(kind, []), right.get(kind, [])
            for tag, i1, i2, j1, j2 in alignment.opcodes([a[i] for i in s], [b[j] for j in c]):
                if tag != "equal":
                    both = min(i2 - i1, j2 - j1)
                    row += [(s[i1 + k], c[j1 + k]) for k in range(both)] + [(i, -1) for i in s[i1 + both : i2]] + [(-1, j) for j in c[j1 + both : j2]]
        out.append(row)
    return pd.Series(out)


def compared(pairs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """pair_id, touched_chars, source_chars and an array of changes of each pair (pair_id, source, candidate), without the texts.

    Per category the values of source and candidate are aligned in order; a change is changed, removed or added. Pairs of equal
    texts have none, and nothing is looked for in them. A null side is the empty text. Rows of one pair_id are told apart.
    """
    source, candidate = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "candidate"))
    unequal = lambda text: F.when(source != candidate, text).otherwise(F.lit(""))
    rows = pairs.select("pair_id", F.length(source).cast("long").alias("source_chars"), unequal(source).alias("source"), unequal(candidate).alias("candidate"))
    found = extracted(rows, {"source": "s", "candidate": "c"}, terms)
    both = lambda side: F.concat(f"{side}_p", f"{side}_a")
    key = lambda s: F.when(s["category"].isin("number", "date", "unit", "operator", *ANCHORS), s["canonical"]).otherwise(s["value"])
    found = found.select("pair_id", "source_chars", _touched("source", "candidate").alias("touched_chars"), both("s").alias("s"), both("c").alias("c"))
    at = lambda side, f: F.transform(F.col(side), f)
    kinds = lambda side: at(side, lambda s: s["category"])

    def told(d: Column) -> Column:
        s, c = (F.when(d[i] >= 0, F.get(side, d[i])) for i, side in enumerate(("s", "c")))
        category = F.coalesce(s["category"], c["category"])
        return F.struct(F.when(category.isin(*PROTECTED), "protected").otherwise("anchor").alias("kind"), category.alias("category"), F.when(d[0] < 0, "added").when(d[1] < 0, "removed").otherwise("changed").alias("change"), s["start"].cast("long").alias("source_start"), s["end"].cast("long").alias("source_end"), s["value"].alias("source_value"), s["canonical"].alias("source_canonical"), c["value"].alias("candidate_value"), c["canonical"].alias("candidate_canonical"))

    aligned = found.withColumn("d", _unequal(kinds("s"), at("s", key), kinds("c"), at("c", key)))
    return aligned.select("pair_id", "source_chars", "touched_chars", F.transform("d", told).alias("changes"))


def sequence_changes(pairs: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """A row for each change of ``compared``: pair_id, kind (protected or anchor), category, change, places and values."""
    return compared(pairs, terms).select("pair_id", F.inline("changes"))


@helper(LongType())
def _touched(source: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([sum(max(i2 - i1, j2 - j1) for tag, i1, i2, j1, j2 in alignment.opcodes(a, b) if tag != "equal") if a != b else 0 for a, b in zip(source, candidate, strict=True)])


def churn(pairs: DataFrame) -> DataFrame:
    """(pair_id, touched_chars, source_chars, churn_ratio): characters that an alignment replaces, deletes or inserts."""
    importable(pairs.sparkSession)
    sides = [F.coalesce(F.col(c), F.lit("")) for c in ("source", "candidate")]
    told = pairs.select("pair_id", _touched(*sides).alias("touched_chars"), F.length(sides[0]).cast("long").alias("source_chars"))
    return told.withColumn("churn_ratio", F.col("touched_chars") / F.greatest(F.lit(1), "source_chars"))


def _permitted(change: Column) -> Column:
    """Whether a permission of the row's pair allows a change; null and empty values are wild cards, canonical forms may be named."""
    named = lambda wanted, side: F.coalesce(wanted, F.lit("")).isin("", change[f"{side}_value"], change[f"{side}_canonical"])
    allowed = F.exists("permissions", lambda p: (p["category"] == change["category"]) & named(p["from_value"], "source") & named(p["to_value"], "candidate"))
    return (change["change"] == "changed") & F.coalesce(allowed, F.lit(False))


def _with_permissions(rows: DataFrame, permissions: DataFrame | None) -> DataFrame:
    """``rows`` of ``compared`` with the permissions of their pair_id, each told once, and whether they allow each change."""
    if permissions is None:
        held = rows.withColumn("permissions", F.array().cast("array<struct<category:string,from_value:string,to_value:string>>"))
    else:
        own = permissions.groupBy("pair_id").agg(F.collect_set(F.struct("category", "from_value", "to_value")).alias("permissions"))
        held = rows.join(own, "pair_id", "left")
    return held.withColumn("changes", F.transform("changes", lambda c: c.withField("authorised", _permitted(c)))).drop("permissions")


def authorised(pairs: DataFrame, permissions: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """``sequence_changes`` with ``authorised``: whether some permission (pair_id, category, from_value, to_value) allows it.

    Null or empty from and to are wild cards; a value or its canonical form may be named. A permission serves any number of
    changes. Only what is changed can be permitted, not what is removed or added.
    """
    return _with_permissions(compared(pairs, terms), permissions).select("pair_id", F.inline("changes"))


def authorised_once(changes: DataFrame, permissions: DataFrame) -> DataFrame:
    """``changes`` with ``authorised``, where each permission is used up by one change.

    Permissions that name more go first: from and to, from alone, to alone, neither. In each turn changes, in the order of
    the text, and permissions of equal terms are ranked, and equal ranks meet; what is left goes on to the next turn.
    """
    terms = ["pair_id", "category"]
    wild = lambda name: F.when(F.col(name) != "", F.col(name))
    wanted = permissions.select(*terms, wild("from_value").alias("source_value"), wild("to_value").alias("candidate_value"))
    left, done = changes, []
    for named in (["source_value", "candidate_value"], ["source_value"], ["candidate_value"], []):
        key = terms + named
        own = wanted
        for name in ("source_value", "candidate_value"):
            own = own.where(F.col(name).isNotNull() if name in named else F.col(name).isNull())
        granted = own.groupBy(key).agg(F.count(F.lit(1)).alias("granted"))
        turn = Window.partitionBy(*key, "change").orderBy("source_start", "source_value", "candidate_value")
        met = left.withColumn("nth", F.row_number().over(turn)).join(granted, key, "left")
        met = met.withColumn("met", F.coalesce((F.col("change") == "changed") & (F.col("nth") <= F.col("granted")), F.lit(False)))
        done.append(met.where("met").select(*changes.columns))
        left = met.where("not met").select(*changes.columns)
    out = left.withColumn("authorised", F.lit(False))
    for part in done:
        out = out.unionByName(part.withColumn("authorised", F.lit(True)))
    return out


def gate(pairs: DataFrame, zones: DataFrame | None = None, permissions: DataFrame | None = None, terms: tuple[str, ...] = (), churn_limit: float = CHURN_LIMIT, churn_multiplier: float = CHURN_MULTIPLIER) -> DataFrame:
    """The decision on each pair (pair_id, source, candidate), with what it rests on.

    reject: a protected span changed without permission or was removed, an anchor that is not for review changed, came or went, or
    the churn is over ``churn_limit`` or over ``churn_multiplier`` times the share of the text that ``zones`` (pair_id, start_pos,
    end_pos: places to be mended) cover. review: only anchors for review differ. Else accept. Rows of one pair_id are told apart,
    and share its zones and permissions. Null sides are empty texts. Texts stay in their row; only counts are joined.
    """
    told = _with_permissions(compared(pairs, terms), permissions)
    mild = lambda c: (c["kind"] == "anchor") & c["category"].isin(*REVIEWED) & ~c["authorised"]
    hard = lambda c: ~c["authorised"] & ~mild(c) & ((c["kind"] == "anchor") | (c["change"] != "added"))
    flags = {"hard_failures": hard, "review_items": mild, "authorised": lambda c: c["authorised"]}
    judged = told.withColumn("churn_ratio", F.col("touched_chars") / F.greatest(F.lit(1), "source_chars")).withColumns({name: F.size(F.filter("changes", held)).cast("long") for name, held in flags.items()}).drop("changes")
    if zones is None:
        judged = judged.withColumns({"zones": F.lit(0), "zone_chars": F.lit(0)})
    else:
        summed = zones.groupBy("pair_id").agg(F.count(F.lit(1)).alias("zones"), F.sum(F.greatest(F.lit(0), F.col("end_pos") - F.col("start_pos"))).alias("zone_chars"))
        judged = judged.join(summed, "pair_id", "left").fillna(0, ["zones", "zone_chars"])
    budget = F.col("zone_chars") / F.greatest(F.lit(1), "source_chars") * churn_multiplier
    judged = judged.withColumns({"over_limit": F.col("churn_ratio") > churn_limit, "over_justified": (F.col("zones") > 0) & (F.col("churn_ratio") > budget)})
    decision = F.when((F.col("hard_failures") > 0) | F.col("over_limit") | F.col("over_justified"), "reject").when(F.col("review_items") > 0, "review").otherwise("accept")
    return judged.select("pair_id", decision.alias("decision"), *flags, "touched_chars", F.round("churn_ratio", 4).alias("churn_ratio"), "over_limit", "over_justified")
