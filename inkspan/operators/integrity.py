"""Output integrity: leaked citations, placeholders, tracking addresses, reasoning, hidden characters, look-alike letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .detect import Detector, found_in

# Patterns of the integrity kinds, tracking parameters, hidden characters, look-alike letters
CITATION = r"(?i)\[(?:source|sources|citation|reference)(?:\s+(?:needed|required|resolved))?[\s:=-]*[^\]]*\]|\((?:source|sources|citation|reference)(?:\s+(?:needed|required|resolved))?[\s:=-]*[^)]*\)"
PLACEHOLDER = r"(?i)\[(?:INSERT|TODO|YOUR TEXT HERE|add|placeholder|TK)[^\]]*\]|Lorem ipsum"
REASONING = (
    r"(?is)\bLet me (?:think about this step by step|think step by step|reason through this|work through this|consider this|analyze this|break this down|start by)\b|\bLet's think (?:about this)?\b"
    r"|\bHere(?:'s| is) my (?:step-by-step )?(?:reasoning|thinking|analysis|plan)\b|\bAs an AI(?: language model)?\b|<(?:thought|thinking|reasoning)[^>]{0,200}>.{0,1000}?</(?:thought|thinking|reasoning)>"
)
PROMPT_TOKEN = r"(?i)<\|(?:im_start|im_end|im_sep|system|user|assistant|model)\|>|\[/?INST\]|</?(?:system|user|assistant)>|<\?xml|ignore (?:all )?previous instructions"
MARKUP = r'(?i)</?[a-z][a-z0-9]*(?:\s+[a-z][a-z0-9\-]*\s*=\s*"[^"]*")*\s*/?>|\*\*|__|~~'
HIDDEN = r"[\x{00AD}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{3164}\x{FEFF}\x{FFA0}]"
LETTER_RUN = r"[A-Za-z\x{0080}-\x{FFFD}]+"
LOOKALIKES = "\u0410\u0415\u041E\u0420\u0421\u0425\u0430\u0435\u043E\u0440\u0441\u0445\u0456\u039F\u03BF"
LOOKALIKE = r"[\x{0410}\x{0415}\x{041E}\x{0420}\x{0421}\x{0425}\x{0430}\x{0435}\x{043E}\x{0440}\x{0441}\x{0445}\x{0456}\x{039F}\x{03BF}]"
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform utm_creative_format utm_marketing_tactic gclid dclid fbclid igshid twclid li_fat_id mc_cid mc_eid ref_src ref_url wt_mc "
    "pk_campaign pk_kwd mkt_tok hs_campaign hs_ad _hsenc _hsmi oly_anon_id oly_enc_id vero_id s_cid cjevent msclkid yclid gbraid wbraid zanpid epik"
).split()
URL = r"https?://[^\s<>\"']+"
SPAN_KINDS = {"provider_citation": CITATION, "placeholder": PLACEHOLDER, "leaked_reasoning": REASONING, "zero_width": HIDDEN}
EDIT_KINDS = {"leaked_prompt_token": PROMPT_TOKEN, "leaked_markup": MARKUP, "hidden_unicode": HIDDEN, "placeholder": PLACEHOLDER}
KINDS = ("provider_citation", "placeholder", "tracking_parameter", "leaked_reasoning", "zero_width", "homoglyph")
SHORT_SAMPLE = 15


def query_keys(url: Column) -> Column:
    """Lower-cased parameter names of an address, without its fragment and trailing punctuation."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"[.,;:!?)\]}]+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.lower(F.split(p, "=")[0]))


def is_tracking(url: Column) -> Column:
    """An address whose every parameter is for tracking; one that has a functional parameter, or none, is not."""
    known, keys = F.array(*map(F.lit, TRACKING)), query_keys(url)
    return (F.size(keys) > 0) & F.forall(keys, lambda k: F.array_contains(known, k))


#: Cheap tests before the patterns: strings of which a lowered text must hold one.
NEEDLES = {
    "provider_citation": ("source", "citation", "reference"),
    "placeholder": ("[insert", "[todo", "[your text here", "[add", "[placeholder", "[tk", "lorem"),
    "leaked_reasoning": ("let me", "let's think", "here", "as an ai", "<thought", "<thinking", "<reasoning"),
    "leaked_prompt_token": ("<|", "inst]", "system>", "user>", "assistant>", "<?xml", "ignore"),
    "leaked_markup": ("<", "**", "__", "~~"),
}


def _looks(kinds: dict[str, str]) -> list[Detector]:
    return [Detector(kind, p, "code_quotes", "strict", NEEDLES.get(kind, ())) for kind, p in kinds.items()]


def integrity_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, finding_id, start_pos, end_pos, value, confidence) outside code and quotes; ids count a kind in order.

    Each row is told on its own: rows of one id share no finding and no count.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), T.word_count(F.col("text")).alias("words"))
    looks = [*_looks(SPAN_KINDS), Detector("tracking_parameter", URL, "code_quotes", "strict", ("http",)), Detector("homoglyph", LETTER_RUN, "code_quotes", "strict", tuple(map(str.lower, LOOKALIKES)))]
    found = found_in(rows, looks, ("doc_id", "row", "words"), fold=False)
    mixed = F.regexp_like("value", F.lit("[A-Za-z]")) & F.regexp_like("value", F.lit(LOOKALIKE))
    found = found.where(F.when(F.col("rule_id") == "tracking_parameter", is_tracking(F.col("value"))).when(F.col("rule_id") == "homoglyph", mixed).otherwise(True))
    nth = F.row_number().over(Window.partitionBy("row", "rule_id").orderBy("start_pos", "end_pos"))
    confidence = F.when(F.col("words") < SHORT_SAMPLE, "uncertain").otherwise("confident")
    return found.select("doc_id", F.col("rule_id").alias("kind"), F.concat(F.lit("oi-"), "rule_id", F.lit("-"), nth).alias("finding_id"), "start_pos", "end_pos", "value", confidence.alias("confidence"))


def edit_defects(docs: DataFrame) -> DataFrame:
    """Placeholders, leaked markup, prompt tokens and hidden characters; markup that overlaps a prompt token of its row is dropped."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = found_in(rows, _looks(EDIT_KINDS), ("doc_id", "row"), fold=False)
    # Tokens do not overlap each other, so of those that start before a finding's end the last one reaches furthest
    before = Window.partitionBy("row").orderBy("start_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    token = F.col("rule_id") == "leaked_prompt_token"
    reach = F.max(F.when(token, F.col("end_pos"))).over(before)
    next_token = F.min(F.when(token, F.col("start_pos"))).over(Window.partitionBy("row").orderBy("start_pos").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    hit = (F.col("rule_id") == "leaked_markup") & (F.coalesce(reach > F.col("start_pos"), F.lit(False)) | F.coalesce(next_token < F.col("end_pos"), F.lit(False)))
    return found.withColumn("hit", hit).where("not hit").select("doc_id", F.col("rule_id").alias("kind"), "start_pos", "end_pos", "value")


def kind_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, n), zeros included."""
    kinds = docs.select("doc_id", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    counted = integrity_findings(docs).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counted, ["doc_id", "kind"], "left").na.fill(0, ["n"])


def compare_to_baseline(current: DataFrame, baseline: DataFrame, enabled: tuple[str, ...] = KINDS) -> DataFrame:
    """The state of each document and kind of ``current`` against ``baseline`` (both doc_id, kind, n)."""
    before = baseline.withColumnRenamed("n", "was")
    joined = current.join(before, ["doc_id", "kind"], "left")
    on = F.col("kind").isin(*enabled)
    state = F.when(~on, "disabled").when(F.col("was").isNull(), "unmatched").when((F.col("was") == 0) & (F.col("n") > 0), "new").when(F.col("n") > F.col("was"), "worsened").when((F.col("n") == 0) & (F.col("was") > 0), "resolved").otherwise("unchanged")
    return joined.select("doc_id", "kind", "n", "was", state.alias("state"))


def tracking_pages(pages: DataFrame) -> DataFrame:
    """Addresses of pages with parameters: how many, and whether all are for tracking."""
    keys = query_keys(F.col("url"))
    return pages.where(F.size(keys) > 0).select("page_id", F.size(keys).cast("long").alias("parameters"), F.array_join(F.array_sort(keys), ",").alias("keys"), is_tracking(F.col("url")).alias("tracking"))
