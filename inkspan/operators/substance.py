"""Substance dimensions, venue features, paragraph order, three-part lists, colon reveals and the preservation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import detect, pairs, stats

# Patterns of the dimensions and the venue features
ANNOUNCEMENT = r"(?i)\b(?:let'?s (?:dive in|dive into|explore|break (?:this|it) down|walk through|look at|take a look at|see how|talk about)|here'?s (?:what you need to know|what we'?ll cover|what to expect|the thing)|in this (?:article|post|guide|essay|blog post|note)|the rest of this (?:article|post|essay)|without further ado|now let'?s|first,? let'?s|let me (?:walk|take|show|share)|i wanted to (?:provide|share|give|walk)|i'?d like to (?:provide|share|walk)|this (?:article|post|essay) (?:will|aims to|covers)|we'?ll (?:cover|look at|explore|discuss)|(?:we are|we'?re) (?:excited|thrilled) to announce)\b"
HANDHOLD = r"(?i)\b(?:let me (?:explain|spell it out|be clear|put it simply)|in other words|simply put|put simply|to put it simply|what this means? is|what that means is|in layman'?s terms|as you know|as we all know|needless to say|it goes without saying|let'?s be clear|to be clear|for those unfamiliar|for the uninitiated|to make a long story short|the point is|the takeaway is|let me reiterate|in essence|at the end of the day)\b"
INAUTHENTIC = r"(?i)\b(?:i hope this helps|hope this helps|let me know if (?:you have any questions|i can help|you'?d like)|if you have any questions,? (?:please )?don'?t hesitate|of course|certainly|great question|excellent question|you'?re absolutely right|that'?s an excellent point|as (?:an|the) (?:ai|language model|assistant)|up to my last (?:training|update)|as of my last (?:training|update|knowledge)|based on available information|while specific details are (?:limited|scarce)|i do not have (?:access to|information about))\b"
CUTTABLE = r"(?i)\b(?:in order to|due to the fact that|at this point in time|it is important to note|it'?s important to note|it is worth noting|it'?s worth noting|as we move forward|going forward|at the end of the day|when it comes to|the fact that|overall|in conclusion|in summary|as a whole|all in all|we remain committed|we are committed|we believe in|it is essential to|it is crucial to|it is critical to|stands? as a testament|serves as a testament)\b"
VAGUE = r"(?i)\b(?:industry (?:observers|reports|leaders|analysts)|experts (?:argue|say|believe|note|agree)|observers (?:have )?cited|studies (?:show|suggest|indicate)|research (?:shows|indicates|suggests)|many (?:organizations|companies|teams|people|developers)|some (?:organizations|companies|teams|people|critics|developers)|several (?:organizations|companies|teams|studies)|a number of|numerous|various|certain|a range of|and more|and beyond|things like that|and stuff|and things|this and that|it is (?:important|essential|crucial|critical|vital) (?:to|that)|significant progress|substantial progress|everyone involved|the whole team)\b"
PUFFERY = r"(?i)\b(?:groundbreaking|revolutioniz(?:e|ing)|transformative|game[- ]changing|cutting[- ]edge|state[- ]of[- ]the[- ]art|world[- ]class|industry[- ]leading|best[- ]in[- ]class|unprecedented|remarkable|extraordinary|unmatched|revolutionary|paradigm[- ]shift|next[- ]generation|seamless(?:ly)?|effortlessly|effortless|production[- ]ready|enterprise[- ]grade|blazing[- ]fast|a testament to|pivotal moment|key turning point|paves? the way|heralds?|significant milestone|crucial role|vital role|essential role|integral part)\b"
STANCE = r"(?i)\b(?:i think|i believe|i find|i'?d rather|i prefer|i keep|in my view|in my experience|from my perspective|as i see it|we should|we shouldn'?t|we'?d rather|the problem is|the real problem is|what gets me|what bothers me|what strikes me|i genuinely|i don'?t know|i suspect|i'?m convinced|i want|i wanted|my take|the way i see it|i was wrong|i should have|the best option|the wrong call)\b"
STAKES = r"(?i)\b(?:without (?:it|this|that)|if (?:we|it|this|that|the)|the result|results? in|leads? to|this means|that would|the cost|the risk|the stakes|consequences?|depends? on|because of this|that'?s why|which (?:means|leaves)|no buffer|rollback|blocker|deadline|the on-call|paged|outage|downtime|when something fails|stalls)\b"
CONCRETE = r"\d|\[[^\]]*\]\([^)]*\)|https?://\S+|`[^`\n]*`|[a-z,] [A-Z][a-z0-9]{2,}\b"
VENUE_FEATURES = {
    "timeline": r"(?i)\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s*(?:am|pm)\b|\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    "impact": r"(?i)\b\d+(?:\.\d+)?\s*%|\b\d+(?:\.\d+)?\s*(?:ms|s|secs?|seconds?|mins?|minutes?|hours?|days?|weeks?|months?|requests?|users?|percent|dollars?|USD|EUR|GBP)\b",
    "contributing_factors": r"(?i)\b(?:because|caused|causing|due to|enabled|since|led to|leads to|contributed|which allowed)\b",
    "uncertainty": r"(?i)\b(?:unknown|unclear|not sure|uncertain|don't know|do not know|probably|likely|hypothesis)\b|\[TK:",
    "repro": r"(?im)\b(?:steps to reproduce|repro|reproduce|version|expected|actual)\b|^[ \t]*\d+\.\s+",
    "acceptance": r"(?im)\b(?:acceptance|done when)\b|^[ \t]*[-*][ \t]*\[[ \t]*\]\s|\bp\d{2,}\b|\bwhen\b[^.\n]{0,60}\bthen\b|\bunder\s+\d+\s*ms\b",
    "answer_first": r"(?i)\A\s*(?:fixed|done|yes|no|merged|shipped|works|reproduced|cannot|can't|won't|wontfix|will|already|found|installed|patched|resolved|blocked|not a bug|not reproduced|closing)\b",
    "breaking_changes": r"(?i)\b(?:breaking|migration|renamed|removing|removed|no longer|now requires|deprecated|renaming)\b",
    "problem_first": r"(?i)\b(?:failed|broke|broken|error|bug|incident|outage|issue|problem|why|crash|went down)\b",
    "reflection_tail": r"(?i)\A\s*(?:in the end|ultimately|in conclusion|in summary|looking back|at the end of the day|what mattered|it was then|this taught|the lesson|all in all|as we look ahead|going forward|in hindsight)\b",
}
CONNECTIVE = r"(?i)\A(?:because|but|however|therefore|thus|so|then|instead|that|this|these|those|such|after|before|once|while|although|as a result|for that reason)\b"
TRICOLON = r"\b[A-Za-z'-]+, [A-Za-z'-]+,? (?:and|or) [A-Za-z'-]+\b"
COLON_REVEAL = r"\b[A-Z][^.!?\n\[\]:]{2,120}:\s+[a-z][^.!?\n\[\]]{1,180}(?:[.!?]|\z)"
LABEL_WORDS = "example lesson note result summary warning".split()
CLAUSE_WORDS = "are be been being can caused could cut did do does had has have is made makes ranked reduced returns returned should was were will would".split()
TREADMILL_WORDS, TREADMILL, SHUFFLE_WORDS, SHUFFLE = 6, 0.6, 7, 0.12


def dimensions(docs: DataFrame) -> DataFrame:
    """A status in each of eight dimensions: evidenced, unsupported or unknown. Quoted and code text does not count."""
    made = docs.select("doc_id", T.mask_code_and_quotes(T.folded(F.coalesce("text", F.lit("")))).alias("t"), T.folded(F.coalesce("text", F.lit(""))).alias("f"))
    made = made.withColumn("n", F.transform(T.sentences(F.col("t")), lambda s: F.size(T.words_of(s))))
    has = lambda p, c="t": F.regexp_like(c, F.lit(p))
    plain = lambda p: F.when(has(p), "unsupported").otherwise("evidenced")
    runs = F.transform(F.slice("n", F.lit(1), F.greatest(F.lit(0), F.size("n") - 2)), lambda x, i: F.greatest(x, F.get("n", i + 1), F.get("n", i + 2)) - F.least(x, F.get("n", i + 1), F.get("n", i + 2)))
    rhythm = F.when(F.size("n") < 3, "unknown").when(F.exists(runs, lambda d: d <= 2), "unsupported").otherwise("evidenced")
    concrete = F.when(has(CONCRETE, "f"), "evidenced").otherwise("unknown")
    voice = F.when(has(STANCE) & has(STAKES), "evidenced").when(~has(STANCE) & has(STANCE, "f"), "unknown").otherwise("unsupported")
    return made.select("doc_id", plain(ANNOUNCEMENT).alias("directness"), rhythm.alias("rhythm"), plain(HANDHOLD).alias("trust"), plain(INAUTHENTIC).alias("authenticity"), plain(CUTTABLE).alias("density"), F.when(has(VAGUE), "unsupported").otherwise(concrete).alias("specificity"), F.when(has(PUFFERY), "unsupported").otherwise(concrete).alias("restraint"), voice.alias("voice"))


def venue_features(docs: DataFrame) -> DataFrame:
    """Which venue features a text shows; the reflection tail is looked for in its last sentence."""
    made = docs.select("doc_id", T.mask_code(T.folded(F.coalesce("text", F.lit("")))).alias("t")).withColumn("last", F.coalesce(F.try_element_at(T.sentences(F.col("t")), F.lit(-1)), F.lit("")))
    return made.select("doc_id", *[F.regexp_like("last" if k == "reflection_tail" else "t", F.lit(p)).alias(k) for k, p in VENUE_FEATURES.items()])


def _content(paragraph: Column) -> Column:
    stop = F.array(*map(F.lit, stats.STOP_WORDS))
    words = F.array_distinct(F.regexp_extract_all(F.lower(paragraph), F.lit(r"[a-z][a-z'-]*"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def paragraph_order(docs: DataFrame) -> DataFrame:
    """Of each text with several paragraphs: how many restate the one before, and the first of three that could trade places."""
    made = docs.select("doc_id", T.paragraphs(T.mask_code(T.folded(F.col("text")))).alias("p")).where("size(p) > 1").withColumn("w", F.transform("p", _content))
    ahead = F.sequence(F.lit(0), F.size("p") - 2)
    w = lambda i: F.get("w", i)
    treads = F.filter(ahead, lambda i: (F.size(w(i)) >= TREADMILL_WORDS) & (F.size(w(i + 1)) >= TREADMILL_WORDS) & (_overlap(w(i), w(i + 1)) >= TREADMILL))
    tied = F.transform(ahead, lambda i: (F.size(w(i)) < SHUFFLE_WORDS) | (F.size(w(i + 1)) < SHUFFLE_WORDS) | F.regexp_like(F.get("p", i + 1), F.lit(CONNECTIVE)) | (_overlap(w(i), w(i + 1)) >= SHUFFLE))
    made = made.withColumn("tied", tied)
    loose = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tied") - 2)), lambda i: ~F.get("tied", i) & ~F.coalesce(F.get("tied", i + 1), F.lit(True)))
    return made.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.size(treads).cast("long").alias("restated"), F.get(loose, F.lit(0)).cast("long").alias("reshuffle_from"))


def tricolons(docs: DataFrame) -> DataFrame:
    """Sentences with a list of three words, and whether they abound: four at least, and a fifth of the sentences."""
    made = stats.sections(docs).withColumn("s", T.sentences(F.col("flat")))
    told = made.select("doc_id", "section", F.size("s").cast("long").alias("sentences"), F.size(F.filter("s", lambda x: F.regexp_like(x, F.lit(TRICOLON)))).cast("long").alias("tricolons")).where("tricolons > 0")
    return told.withColumn("dense", (F.col("tricolons") >= 4) & (F.col("tricolons") / F.col("sentences") >= 0.2))


def colon_reveals(docs: DataFrame) -> DataFrame:
    """Capitalised noun phrase, colon, lower-case reveal; not where a label or a clause stands before the colon."""
    found = detect.found_in(docs, [detect.Detector("struct-colon-reveal", COLON_REVEAL, "code_quotes", needles=(":",))])
    words = F.regexp_extract_all(F.lower(T.folded(F.regexp_extract("value", "^([^:]*):", 1))), F.lit("[a-z]+"), F.lit(0))
    bears = F.array_contains(F.array(*map(F.lit, LABEL_WORDS)), F.element_at(words, -1)) | F.arrays_overlap(words, F.array(*map(F.lit, CLAUSE_WORDS)))
    return found.where(~bears)


def gate(source_candidate: DataFrame) -> DataFrame:
    """The decision on each pair (pair_id, source, candidate): reject if a literal is lost or an anchor other than a name or an
    attribution changes, review if only those change, else accept. Literals that are only added never count."""
    counted = pairs.value_counts(source_candidate, pairs.LITERALS | pairs.ANCHORS, outer=True)
    literal, mild = F.col("category").isin(*pairs.LITERALS), F.col("category").isin("attribution", "name")
    weight = F.when(literal & (F.col("n") > 0), 2).when(~literal & (F.col("n") != 0), F.when(mild, 1).otherwise(2))
    worst = counted.groupBy("row", "pair_id").agg(F.max(weight).alias("w"), F.count(weight).alias("changes"))
    return worst.select("pair_id", F.when(F.col("w") == 2, "reject").when(F.col("w") == 1, "review").otherwise("accept").alias("decision"), "changes")
