"""Span findings: lexical rules and registered pattern detectors over documents (doc_id, text).

A finding is (doc_id, rule_id, signal, evidence, start_pos, end_pos, value) with half-open code-point offsets into the
original text. A rule is a pattern in the plan, looked for once in a text that holds one of the words it waits for; nothing is shuffled.
Null texts give no findings; repeated rows give repeated findings, and each row's are its own: ``found_in`` carries columns
of the row along, so that no finding has to be joined back to its text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from . import measured as M

EMOJI = r"\x{1F000}-\x{1FAFF}\x{2B50}\x{2705}\x{274C}\x{274E}\x{2757}\x{2764}"
# Signal terms and the evidence that excuses a claim
SIGNALS = {
    "importance": ("pivotal", "crucial", "transformative", "significant", "vital", "underscores", "underscored", "testament", "plays a key role", "represents a shift", "broader trend"),
    "impact": ("impact", "game-changer", "game changing", "huge impact", "dramatic", "enormous", "massive", "moved the needle", "reduced", "reduces", "improved", "improves", "boosted", "boosts", "cut the time"),
    "causality": ("causes", "caused", "causing", "is responsible for", "is the reason", "leads to", "led to", "results in", "resulted in", "stems from"),
    "superiority": ("best-in-class", "world-class", "unbeatable", "superior", "the best", "better than", "the fastest", "the only", "leading provider", "cutting-edge", "groundbreaking", "best"),
}
MEASURE = r"\b\d+(?:[.,]\d+)?\s*(?:%|×)|\b\d+(?:[.,]\d+)?\s*[xX]\b|\b\d+(?:[.,]\d+)?\s*[- ]?(?:ms|secs?|minutes?|hours?|days?|weeks?|months?|years?|kb|mb|gb|tb|services?|runs?|tests?|launches?)\b"
OBSERVATION = r"(?i:\b(?:measured|tested|observed|benchmarked|tracked|recorded|benchmark|experiment|study|survey|load test|a/b test|pilot)\b)"
#: Capitalised words after something that ends no sentence; one that is not in ACTOR_STOP names an actor.
NAMED_ACTOR = r"[^.!?\s]\s*\b((?:[A-Z][A-Za-z0-9]{2,}\s+)*[A-Z][A-Za-z0-9]{2,})\b"
ACTOR_STOP = (
    "The This That These Those It We Our You Your They Their There Here But And Or So Yet Then Thus Hence When If For In On At As No Not Nor Which What How Why Where Who Whom One Two Most Many Some Every Each "
    "Both Because Although However Also While After Before During Since Until Using Through Within Without Under Over Beyond About Above"
).split()
NUMBER = r"\b\d+(?:[.,]\d+)?"
COUNTED = "companies|organizations|organisations|firms|businesses|startups|teams|developers|engineers|users|customers|clients|subscribers|apps|applications|services|servers|hosts|nodes|instances|containers|reports|findings|incidents|vulnerabilities|breaches|attacks|cases|studies|surveys|respondents|participants|requests|queries|commits|releases|deployments|features"
STATISTIC = rf"(?:{NUMBER}\s*(?:%|percent(?:age)?\b)|{NUMBER}\s*[x×]\b|\b\d+\s+(?:in|out of)\s+\d+\b|\b\d+\s+of\s+\d+\b|{NUMBER}\s+(?:{COUNTED})\b)"
SOURCED = r"(?i:\[[^\]]*\]\([^)]*\)|https?://\S+|\[[0-9]+\]|\(\s*(?:see\s+)?[A-Z][A-Za-z.'-]+,?\s+[0-9]{4}\s*\)|\b(?:according to|reported by|reported in|reported that|cited in|based on|sourced? from|source:|citation:|data from|findings from|per\s+[A-Z]|report\s+(?:by|from)|(?:a|the)\s+[0-9]{4}\s+report|study|survey|research|analysis|findings?)\b)"
SUPPLIED = r"(?i:\b(?:measured|observed|counted|tracked|recorded|benchmarked|tested|audited|surveyed|sampled|found|calculated|computed|quantified|detected|experiments?|pilot|load test|a/b test|benchmark|reduced|reduces|cut|improved|improves|boosted|increased|decreased|dropped|doubled|halved|tripled|saved|gained|lost|grew|rose|fell|shrank|ranked|scored|achieved|eliminated|caused|causes|causing|resulted in|leads? to|produced|our\s+(?:audit|test|measurement|data|results)|we\s+ran)\b)"
TECHNICAL = r"(?i:\b(?:spec|specification|standard|sla|rfc|protocol|limit|threshold|baseline|config|configuration|configured|constant|nominal|rated|fixed|hardcoded|parameter|setting|budget|cap|ceiling|floor|guarantee|guarantees)\b)"
ESTIMATED = r"(?i:\b(?:about|approximately|approx|roughly|around|nearly|almost|circa|some|up to|at least|at most|more than|less than|over|under|close to|on the order of|give or take)\b)"
DECISION = r"(?i:\b(?:choose|chooses|chose|use|uses|using|prefer|prefers|pick|picks|decide|decided|opt|opted|select|selects|recommend|recommended|switch|switched|replace|replaced|trade|substitute|should|must|instead|avoid|avoiding)\b)"
RESULT = r"(?i:\b\d+(?:[.,]\d+)?\s*(?:%|(?:x|ms|secs?|minutes?|hours?|days?|runs?|times?|fold|points?)\b))"
COMPARISON = r"(?i:\b(?:baseline|benchmark|on par|comparable|matches?|within\s+[0-9.]|margin|difference|ahead of|behind)\b)"


class Detector(NamedTuple):
    key: str
    pattern: str
    mask: str = ""  # what is blanked before: code, code_quotes or prose
    signal: str = "advisory"
    needles: tuple[str, ...] = ()  # strings of which a lower-cased text must hold one
    words: tuple[str, ...] = ()  # whole words of which it must hold one
    excuse: str = ""  # no finding if this is found within ``around`` characters
    around: int = 0
    actors: bool = False  # nor if an actor is named there
    estimates: bool = False  # nor if the words next to it mark an estimate
    restated: bool = False  # nor unless the line after it says half of its words again
    phrases: tuple[str, ...] = ()  # strings of which a lower-cased text must hold one beside a word
    beyond_ascii: bool = False  # only in texts that hold more than ASCII
    figures: bool = False  # only in texts that hold a digit
    heads: str = ""  # letters and digits that a match begins with, if it begins with any of few

    @property
    def looks(self) -> tuple:
        """What is looked at around a match."""
        return self.excuse, self.around, self.actors, self.estimates, self.restated


#: Characters and words before and after a figure in which an estimate is looked for.
ESTIMATE_BEFORE, ESTIMATE_AFTER, WORDS_BEFORE, WORDS_AFTER = 40, 16, 4, 3
OR_SO = r"(?i)^(?:or so|give or take)\b"
#: Characters after a heading that are looked at, those of its first line that count, and the least letters of a word said again.
RESTATED_WITHIN, RESTATED_LINE, RESTATED_WORD = 200, 140, 4


def _signal(name: str) -> Detector:
    terms = "|".join(sorted(SIGNALS[name], key=len, reverse=True))
    return Detector(f"mechanism_{name}", rf"(?i)\b(?:{terms})\b", "code", words=tuple(max(rules.words_in(t), key=len) for t in SIGNALS[name]), heads="".join(t[0] for t in SIGNALS[name]), excuse=f"{MEASURE}|{OBSERVATION}", around=120, actors=True)


# Patterns of the registered detectors
DETECTORS = [
    Detector("fmt_em_dash", "—|–| -- ", signal="strict", needles=("—", "–", " -- ")),
    Detector("fmt_curly_quotes", "[‘’“”]", signal="strict", needles=("‘", "’", "“", "”")),
    Detector("fmt_emojis", rf"[{EMOJI}\x{{FE0F}}]", "code_quotes", "strict", beyond_ascii=True),
    Detector("fmt_emoji_bullets", rf"(?m)^[ \t]*(?:[-*]|\d+[.)])[ \t]*[{EMOJI}]", "code_quotes", "strict", beyond_ascii=True),
    Detector("fmt_inline_header", r"\*\*[^*]+?(?::\*\*|\*\*\s*:)", "code_quotes", "strict", needles=("**",)),
    Detector("fmt_exclamation", "!", "code_quotes", needles=("!",)),
    Detector("fmt_compound_hyphen", r"\b[A-Za-z]+ly-\w+\b", "code_quotes", needles=("ly-",)),
    Detector("chat_citation_leaks", r"citeturn\d+\w*|oai_citation|\[attached_file:\d+\]", signal="strict", needles=("citeturn", "oai_citation", "[attached_file:")),
    Detector("ai_url_parameters", r"utm_source=(?:chatgpt|openai|claude|perplexity)\.com", signal="strict", needles=("utm_source=",)),
    Detector("unfilled_placeholders", r"\[(?:Your Name|INSERT [A-Z_ ]+|TODO|TBD|YOUR TEXT HERE)\]", "code", "strict", needles=("[",)),
    Detector("struct_link_text", r"(?i)\[(?:click here|learn more|read more|here|this link)\]\([^ )\n]+\)", "code", needles=("](",)),
    Detector("engagement_bait", r"(?i)\b(?:have you ever (?:wondered|thought|noticed|asked)|ever wondered|ever thought about|picture this|imagine (?:this|if)|let me ask you something|you won'?t believe|let'?s be honest|raise your hand if|we'?ve all been there|you might be wondering|you may be wondering|i know what you'?re thinking)\b", "code", heads="hepilyrw", words=("ever", "picture", "imagine", "something", "believe", "honest", "hand", "been", "wondering", "thinking")),
    Detector("template_headings", r"(?im)^#{1,6}\s+(?:introduction|conclusion|overview|summary|key\s+takeaways|takeaways|faq|frequently\s+asked\s+questions|getting\s+started|the\s+basics|background|the\s+problem|the\s+solution|next\s+steps|benefits|features|challenges|best\s+practices|pros\s+and\s+cons|what\s+is|what\s+are|why\s+(?:do|does|is|are|should)|why\b[^\n]*\bmatters?|how\s+it\s+works|how\s+does)\b", "code", needles=("#",)),
    Detector("self_promotion", r"(?i)\b(?:as\s+an?\s+industry\s+leader|industry[- ]leading|market[- ]leading|best[- ]in[- ]class|world[- ]class|leading\s+(?:provider|vendor|platform|solution|product|company)|we'?re\s+proud|we\s+are\s+proud|proudly\s+(?:announce|present|introduce|offer)|trusted\s+by|trusted\s+across|loved\s+by|used\s+by\s+(?:thousands|millions)|pioneer\s+in|unmatched|second\s+to\s+none|premier|state[- ]of[- ]the[- ]art)\b", "code_quotes", excuse=COMPARISON, around=60, heads="aimbwlptus", words=("industry", "market", "best", "world", "leading", "proud", "proudly", "trusted", "loved", "used", "pioneer", "unmatched", "second", "premier", "state")),
    Detector("rather_than", r"(?i)\b\w[\w'-]*\s+rather\s+than\s+\w[\w'-]*\b", "code_quotes", excuse=f"{DECISION}|{RESULT}", around=60, words=("rather",)),
    Detector("unsourced_precision", STATISTIC, "prose", figures=True, heads="0123456789", excuse=f"{SOURCED}|{SUPPLIED}|{TECHNICAL}", around=120, estimates=True),
    Detector("social_reach_promise", r"(?i)\b(?:boost|grow|increase|drive|raise|expand|multiply|get more)\s+(?:your\s+)?(?:reach|engagement|impressions|visibility|saves|comments|likes|shares|followers|network|traffic|exposure)\b|\b(?:go(?:es)? viral|going viral)\b|\bthe algorithm (?:loves|rewards|prefers|boosts|picks up)\b|\balgorithmic (?:boost|benefit|growth)\b|\b(?:opening weight|dwell time)\b|\breach (?:a|the) wider audience\b|\bseen by more people\b|\bgrow your (?:network|audience)\b", "code", words=("boost", "grow", "increase", "drive", "raise", "expand", "multiply", "get", "viral", "algorithm", "algorithmic", "opening", "dwell", "wider", "seen")),
    Detector("struct_artificial_line_breaks", r"[A-Za-z,]\n[a-z]", "code", needles=("\n",)),
    *(_signal(name) for name in SIGNALS),
]
BY_KEY = {d.key: d for d in DETECTORS}
#: Registered detectors by the rule that names them; a detector without a rule is reported under its own key.
RULE_OF = {r.detector: r.rule_id for r in rules.RULES if r.detector}


MASKS = {"": lambda t: t, "code": T.mask_code, "code_quotes": T.mask_code_and_quotes, "prose": T.mask_prose}
#: The masks that go on top of ``code``.
ON_CODE = {"code_quotes": T.mask_quotes, "prose": T.mask_no_prose}
#: Detectors that only one profile asks for.
PROFILE_ONLY = {"social_reach_promise": "social"}


def restates(heading: Column, after: Column) -> Column:
    """Whether half of a heading's words or more, of four letters at least, begin a word of the line after it or begin with one."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(T.WORD), F.lit(0)))
    line = F.substring(F.substring_index(F.regexp_replace(after, r"^\n+", ""), "\n\n", 1), 1, RESTATED_LINE)

    def told(said: Column, again: Column) -> Column:
        shared = F.size(F.filter(said, lambda w: (F.length(w) >= RESTATED_WORD) & F.exists(again, lambda c: F.startswith(c, w) | F.startswith(w, c))))
        return (shared > 0) & (2 * shared >= F.size(said))

    return T.let(F.struct(words(F.regexp_replace(heading, r"^#{1,6}\s*", "")).alias("said"), words(line).alias("again")), lambda x: told(x["said"], x["again"]))


def excused(d: Detector, held: Column, start: Column, end: Column) -> Column:
    """Whether what stands around a match excuses it; ``held`` is the text in parts."""

    def within(before: int, after: int) -> Column:
        first = F.greatest(F.lit(0), start - before)
        return T.taken(held, first, end + after - first)

    out = F.lit(False)
    if d.estimates:
        first = F.greatest(F.lit(0), start - ESTIMATE_BEFORE)
        before, after = T.taken(held, first, start - first), T.taken(held, end, F.lit(ESTIMATE_AFTER))
        words, then = (F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)) for x in (before, after))
        tail = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - WORDS_BEFORE + 1), F.lit(WORDS_BEFORE)), " ")
        head = F.array_join(F.slice(then, 1, WORDS_AFTER), " ")
        out = out | F.regexp_like(tail, F.lit(ESTIMATED)) | F.regexp_like(head, F.lit(OR_SO)) | F.contains(F.right(before, F.lit(3)), F.lit("~")) | F.contains(F.left(after, F.lit(3)), F.lit("~"))
    if d.excuse:
        out = out | F.regexp_like(within(d.around, d.around), F.lit(T.quick(d.excuse)))
    if d.actors:
        runs = F.regexp_extract_all(within(d.around, d.around), F.lit(T.quick(NAMED_ACTOR)), F.lit(1))
        out = out | F.exists(F.split(F.array_join(runs, " "), r"\s+"), lambda w: (w != "") & ~w.isin(*ACTOR_STOP))
    if d.restated:
        out = out | ~restates(T.taken(held, start, end - start), T.taken(held, end, F.lit(RESTATED_WITHIN)))
    return out


def found_in(docs: DataFrame, wanted: list[Detector], keep: tuple[str, ...] = ("doc_id",), fold: bool = True, outer: bool = False, measures: tuple[M.Measure, ...] = (), valued: bool = True) -> DataFrame:
    """Findings with the columns ``keep`` of their rows; ``outer``: and a row of nulls for each row that has none. Those that are
    not ``valued`` have no column value, which is much of the work where a text has many.

    ``measures`` adds the findings of document-level detectors; those of evidence ``document`` carry no value, as it may be the
    whole text.

    Texts are cut at the matches of each rule whose words or needles they hold, once, by patterns that are part of the plan; what
    is exploded is a row for each rule found, then its finished findings. Values are cut from parts of the text, so that many
    matches of a long text take time in proportion to their number.
    """
    masks = sorted({d.mask for d in wanted} | ({"code_quotes"} if measures else set()))
    prepared = docs.select(*keep, *[F.col("text")] * ("text" not in keep), T.unmarked(F.col("text")).alias("_folded"))
    prepared = prepared.withColumn("_folded", T.folded(F.col("_folded"))) if fold else prepared
    # Code is blanked in a step of its own: a mask on top of it names what it reads many times
    prepared = prepared.withColumns({"_code": T.mask_code(F.col("_folded")), "_lower": F.lower("_folded")} if any(masks) else {"_lower": F.lower("_folded")})
    prepared = prepared.withColumns({f"_{m}": ON_CODE[m](F.col("_code")) for m in masks if m in ON_CODE})
    names = {m: f"_{m}" if m else "_folded" for m in masks}
    around = sorted({names[d.mask] for d in wanted if any(d.looks)})
    listed = lambda values: "array(" + ", ".join(map(T.literal, values)) + ")"
    # Words are looked up once in a set of all that any rule waits for; what is left of them is a few
    waited = sorted({w for d in wanted for w in d.words} | ({w for m in measures for w in m.words}))
    prepared = prepared.withColumn("_held", F.expr(f"array_distinct(regexp_extract_all(_lower, {T.literal(T.any_word(waited))}, 0))" if waited else "array('')"))
    none = "CAST(NULL AS ARRAY<STRUCT<`start`: INT, `end`: INT>>)"
    if measures:
        cut_up, prose, found = M.united(measures)
        prepared = prepared.withColumns({"_sections": cut_up, "_linked": prose}).withColumn("_measured", found)
    cut = []
    for i, d in enumerate(wanted):
        likely = " OR ".join([f"arrays_overlap(_held, {listed(d.words)})"] * bool(d.words) + [f"contains(_lower, {T.literal(n)})" for n in d.needles]) or "true"
        if d.phrases:
            likely = f"({likely}) AND (" + " OR ".join(f"contains(_lower, {T.literal(p)})" for p in d.phrases) + ")"
        if d.beyond_ascii:
            likely = f"octet_length({names[d.mask]}) > char_length({names[d.mask]})"
        if d.figures:
            likely = f"regexp_like({names[d.mask]}, '[0-9]')"
        cut.append(f"CASE WHEN {likely} THEN named_struct('rule', {i}, 'lens', {T.lengths_sql(names[d.mask], T.beginning(d.heads, d.pattern))}, 'at', {none}) END")
    united = f"array({', '.join(cut)})"
    if measures:
        empty = "CAST(NULL AS ARRAY<STRUCT<`h`: INT, `g`: INT>>)"
        united = f"concat({united}, transform(_measured, m -> named_struct('rule', m.rule + {len(wanted)}, 'lens', {empty}, 'at', m.at)))"
    # An outer explode is not preceded by a filter that would work the matches out once more
    prepared = prepared.withColumn("_rules", F.expr(f"filter({united}, r -> size(r.lens) > 1 OR size(r.at) > 0)"))
    # Only texts that values are cut from, or that are looked into around a match, are cut into parts
    held_in = lambda name: F.exists("_rules", lambda r: r["rule"].isin(*[i for i, d in enumerate(wanted) if any(d.looks) and names[d.mask] == name]))
    whole = {"_parts": F.when(F.size("_rules") > 0, T.parts(F.col("text")))} if valued or any(d.restated for d in wanted) else {}
    prepared = prepared.withColumns(whole | {f"_parts{name}": F.when(held_in(name), T.parts(F.col(name))) for name in around})
    ruled = prepared.withColumn("_r", F.explode_outer("_rules"))
    rule, of = F.col("_r.rule"), lambda values: F.get(F.array(*map(F.lit, values)), rule)
    evidence = of(["span"] * len(wanted) + [m.evidence for m in measures])

    def told(s: Column) -> Column:
        """A finding with its value; null if what stands around it excuses it."""
        start, end, excuse = s["start"], s["end"], F.lit(False)
        for d in {(d.mask, *d.looks): d for d in wanted if any(d.looks)}.values():
            alike = [i for i, x in enumerate(wanted) if (x.mask, *x.looks) == (d.mask, *d.looks)]
            excuse = F.when(rule.isin(*alike), excused(d, F.col("_parts" if d.restated else f"_parts{names[d.mask]}"), start, end)).otherwise(excuse)
        value = [F.when(evidence == "span", T.taken(F.col("_parts"), start, end - start)).alias("value")] if valued else []
        return F.when(~F.coalesce(excuse, F.lit(False)), F.struct(start.cast("long").alias("start_pos"), end.cast("long").alias("end_pos"), *value))

    # Findings are finished inside the row of their rule: what is exploded holds no text
    found = F.filter(F.transform(F.coalesce(F.col("_r.at"), T.placed(F.col("_r.lens"))), told), lambda f: f.isNotNull())
    rows = (ruled if outer else ruled.where("_r is not null")).select(*keep, rule.alias("_rule"), found.alias("_found"))
    rule = F.col("_rule")
    # Spark puts a test of what is exploded before an inner explode, which would find and cut all values twice more
    spans = rows.select(*keep, "_rule", F.explode_outer("_found").alias("_f"))
    spans = spans if outer else spans.where("_f is not null")
    finding = {
        "rule_id": of([RULE_OF.get(d.key, d.key) for d in (*wanted, *measures)]),
        "signal": of([d.signal for d in (*wanted, *measures)]),
        "evidence": of(["span"] * len(wanted) + [m.evidence for m in measures]),
    }
    held = F.col("_f").isNotNull()
    return spans.select(*keep, *[(F.when(held, c) if outer else c).alias(name) for name, c in finding.items()], "_f.start_pos", "_f.end_pos", *["_f.value"] * valued)


def lexical(profile: str = "general") -> list[Detector]:
    return [Detector(r.rule_id, p, "", r.signal, words=tuple(rules.waits_for(r)), phrases=tuple(rules.phrases(r)), heads=rules.heads(r)) for r in rules.active(profile) if (p := rules.pattern(r))]


def patterns_of(profile: str = "general") -> list[Detector]:
    return [d for d in DETECTORS if PROFILE_ONLY.get(d.key, profile) == profile]


def lexical_findings(docs: DataFrame, profile: str = "general") -> DataFrame:
    """Exact and phrase matches of a profile's lexical rules."""
    return found_in(docs, lexical(profile))


def pattern_findings(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matches of registered pattern detectors, all or those of ``keys``."""
    return found_in(docs, [BY_KEY[k] for k in keys or BY_KEY])


def measured_findings(docs: DataFrame) -> DataFrame:
    """Findings of the document-level detectors alone."""
    return found_in(docs, [], measures=tuple(M.MEASURES))


def all_findings(docs: DataFrame, profile: str = "general", keep: tuple[str, ...] = ("doc_id",), outer: bool = False, measured: bool = True, valued: bool = True) -> DataFrame:
    """Lexical and pattern findings of a profile, and unless ``measured`` is false those of document-level detectors, in one pass
    over the rows."""
    return found_in(docs, lexical(profile) + patterns_of(profile), keep, outer=outer, measures=tuple(M.MEASURES) if measured else (), valued=valued)
