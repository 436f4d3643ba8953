"""The rule registry: scored rules, their weights, profiles, corrections and score bands.

The severities of formatting, filler and chatbot rules and the profile lists are assumed where no public table shows them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Id | category | severity | review mode | detector | text
_TABLE = """
vocab-agile | vocabulary | high | deterministic |  | agile / agility
vocab-ascertain | vocabulary | high | deterministic |  | ascertain
vocab-commence | vocabulary | high | deterministic |  | commence
vocab-comprehensive | vocabulary | high | deterministic |  | comprehensive
vocab-cutting-edge | vocabulary | high | deterministic |  | cutting-edge
vocab-delve | vocabulary | high | deterministic |  | delve
vocab-discontinue | vocabulary | high | deterministic |  | discontinue
vocab-dispatch | vocabulary | high | deterministic |  | dispatch
vocab-dynamic | vocabulary | high | deterministic |  | dynamic
vocab-embark | vocabulary | high | deterministic |  | embark
vocab-empower | vocabulary | high | deterministic |  | empower
vocab-enhance | vocabulary | high | deterministic |  | enhance
vocab-facilitate | vocabulary | high | deterministic |  | facilitate
vocab-foster | vocabulary | high | deterministic |  | foster
vocab-groundbreaking | vocabulary | high | deterministic |  | groundbreaking
vocab-holistic | vocabulary | high | deterministic |  | holistic
vocab-implement | vocabulary | high | deterministic |  | implement
vocab-innovative | vocabulary | high | deterministic |  | innovative
vocab-interplay | vocabulary | high | deterministic |  | interplay
vocab-leverage | vocabulary | high | deterministic |  | leverage
vocab-navigate | vocabulary | high | deterministic |  | navigate
vocab-obtain | vocabulary | high | deterministic |  | obtain
vocab-pivotal | vocabulary | high | deterministic |  | pivotal
vocab-revolutionize | vocabulary | high | deterministic |  | revolutionize
vocab-robust | vocabulary | high | deterministic |  | robust
vocab-seamless | vocabulary | high | deterministic |  | seamless
vocab-showcase | vocabulary | high | deterministic |  | showcase
vocab-significant | vocabulary | high | deterministic |  | significant
vocab-streamline | vocabulary | high | deterministic |  | streamline
vocab-subsequently | vocabulary | high | deterministic |  | subsequently
vocab-supercharge | vocabulary | high | deterministic |  | supercharge
vocab-synergy | vocabulary | high | deterministic |  | synergy
vocab-tapestry | vocabulary | high | deterministic |  | tapestry
vocab-testament | vocabulary | high | deterministic |  | testament
vocab-transformative | vocabulary | high | deterministic |  | transformative
vocab-unlock | vocabulary | high | deterministic |  | unlock
vocab-unpack | vocabulary | high | deterministic |  | unpack
vocab-utilize | vocabulary | high | deterministic |  | utilize
vocab-vibrant | vocabulary | high | deterministic |  | vibrant
phrase-actionable-insights | phrase | high | deterministic |  | actionable insights
phrase-at-core | phrase | high | deterministic |  | At its core / at the end of the day / the real question is / what really matters / fundamentally / in reality / the deeper issue is
phrase-best-in-class | phrase | high | deterministic |  | best-in-class
phrase-cannot-denied | phrase | high | deterministic |  | It cannot be denied that
phrase-complexity-signal | phrase | high | deterministic |  | This is more complex than it appears / The reality is more nuanced / It's complicated
phrase-constantly-evolving | phrase | high | deterministic |  | constantly evolving
phrase-creeps-in | phrase | high | deterministic |  | creeps in
phrase-despite-thrive | phrase | high | deterministic |  | Despite challenges, continues to thrive
phrase-discovery-narration | phrase | high | deterministic |  | As I explored this further / What I found surprised me / The more I looked
phrase-dive-in | phrase | high | deterministic |  | Let's dive in / let's delve deeper
phrase-ever-evolving | phrase | high | deterministic |  | Ever-evolving landscape / constantly evolving / dynamic world of / in the realm of
phrase-expert-cosplay | phrase | high | deterministic |  | This is the part most people skip / What most people get wrong / Here's what nobody tells you / The part everyone misses
phrase-explore | phrase | high | deterministic |  | I want to explore...
phrase-full-stop | phrase | high | deterministic |  | Full stop. / Period.
phrase-future-bright | phrase | high | deterministic |  | The future looks bright / exciting times ahead
phrase-goes-without-saying | phrase | high | deterministic |  | it goes without saying
phrase-heres-thing | phrase | high | deterministic |  | Here's the thing: / Here's what [X] / Here's why [X] / Here's the problem though:
phrase-hint-plot-spoiler | phrase | high | deterministic |  | Hint: / Plot twist: / Spoiler:
phrase-knowledge-cutoff | phrase | high | deterministic |  | As of my knowledge cutoff
phrase-let-me-clear | phrase | high | deterministic |  | Let me be clear
phrase-let-sink-in | phrase | high | deterministic |  | Let that sink in
phrase-make-no-mistake | phrase | high | deterministic |  | Make no mistake
phrase-optimal-outcomes | phrase | high | deterministic |  | optimal outcomes
phrase-second-to-none | phrase | high | deterministic |  | second to none
phrase-self-answered-qa | phrase | high | deterministic |  | Self-answered question pairs
phrase-stay-ahead | phrase | high | deterministic |  | stay ahead of the curve
phrase-thats-okay | phrase | high | deterministic |  | And that's okay.
phrase-think-about-it | phrase | high | deterministic |  | Think about it:
phrase-today-world | phrase | high | deterministic |  | In today's fast-paced world / in today's rapidly changing world / in today's landscape
phrase-transition-glue | phrase | high | deterministic |  | With that in mind / Against this backdrop / Taken together / Zooming out / Building on this
phrase-treasure-trove | phrase | high | deterministic |  | Treasure trove / uncharted waters / embark on a journey
phrase-underscores | phrase | high | deterministic |  | This underscores the importance of
phrase-walk-through | phrase | high | deterministic |  | Let me walk you through...
phrase-what-if-i-told | phrase | high | deterministic |  | What if I told you...
phrase-what-looks-like | phrase | high | deterministic |  | This is what X actually looks like
phrase-worth-noting | phrase | high | deterministic |  | It's worth noting that
phrase-agile-adaptation | phrase | high | human |  | agile / agility
phrase-game-changer | phrase | high | advisory |  | Game-changer
phrase-not-just | phrase | high | advisory |  | Not just X, but Y
phrase-research-shows | phrase | high | advisory |  | Research shows / experts believe (without named source)
phrase-absolutely-right | phrase | medium | deterministic |  | You're absolutely right / That's a great point
phrase-certainly | phrase | medium | deterministic |  | Certainly / Absolutely / Great question
phrase-end-to-end | phrase | medium | deterministic |  | end-to-end
phrase-hope-helps | phrase | medium | deterministic |  | I hope this helps! / Let me know if you have questions!
phrase-in-conclusion | phrase | medium | deterministic |  | In conclusion / To summarize / To wrap up
phrase-moreover | phrase | medium | advisory |  | Moreover / Furthermore / Additionally
filler-at-point-in-time | filler | medium | deterministic |  | At this point in time
filler-crucial | filler | medium | deterministic |  | It's crucial to
filler-due-to-fact | filler | medium | deterministic |  | Due to the fact that
filler-important-note | filler | medium | deterministic |  | It is important to note that
filler-in-order | filler | medium | deterministic |  | In order to
filler-system-ability | filler | medium | deterministic |  | The system has the ability to
filler-padding-adverbs | filler | medium | advisory |  | Padding adverbs
struct-ai-url-parameters | structural | high | advisory | ai_url_parameters |
struct-balanced-take | structural | high | human |  |
struct-chat-citation-leaks | structural | high | advisory | chat_citation_leaks |
struct-paragraph-duplication | structural | high | deterministic | paragraph_duplication |
struct-rhetorical-hooks | structural | high | advisory |  |
struct-significance-inflation | structural | high | advisory |  |
struct-specificity-theater | structural | high | human |  |
struct-unfilled-placeholders | structural | high | advisory | unfilled_placeholders |
struct-all-same-length | structural | medium | advisory |  |
struct-announce-structure | structural | medium | advisory |  |
struct-anthropomorphized-silence | structural | medium | human |  |
struct-antithesis | structural | medium | human |  |
struct-artificial-line-breaks | structural | medium | advisory | struct_artificial_line_breaks |
struct-awkward-metaphors | structural | medium | human |  |
struct-bullet-crutch | structural | medium | human |  |
struct-catalog-prose | structural | medium | human |  |
struct-colon-overuse | structural | medium | advisory |  |
struct-colon-reveal | structural | medium | advisory | struct_colon_reveal |
struct-complexity-signalling | structural | medium | human |  |
struct-concession-rhythm | structural | medium | human |  |
struct-copula-avoidance | structural | medium | human |  |
struct-corrective-reveals | structural | medium | human |  |
struct-discovery-narration | structural | medium | human |  |
struct-emphasis-tails | structural | medium | human |  |
struct-empty-declaratives | structural | medium | human |  |
struct-ending-cliches | structural | medium | human |  |
struct-engagement-bait | structural | medium | advisory | engagement_bait |
struct-false-ranges | structural | medium | human |  |
struct-fragmented-headers | structural | medium | advisory |  |
struct-heading-hierarchy | structural | medium | advisory | heading_hierarchy |
struct-hedged-reactions | structural | medium | human |  |
struct-ing-analyses | structural | medium | human |  |
struct-it-turns-out | structural | medium | advisory |  |
struct-link-text | structural | medium | advisory | struct_link_text |
struct-listicle-trenchcoat | structural | medium | advisory |  |
struct-negation-flip | structural | medium | human |  |
struct-notability-dropping | structural | medium | human |  |
struct-numbered-list-inflation | structural | medium | advisory | numbered_list_inflation |
struct-overlong-sentence | structural | medium | advisory | struct_overlong_sentence |
struct-paragraph-length-variance | structural | medium | advisory | paragraph_length_variance |
struct-paragraph-redundancy | structural | medium | human |  |
struct-paragraph-reshuffle | structural | medium | advisory | paragraph_reshuffle |
struct-paragraph-similarity | structural | medium | advisory | paragraph_similarity |
struct-parataxis | structural | medium | advisory |  |
struct-passage-density | structural | medium | advisory | passage_density |
struct-passive-density | structural | medium | deterministic | passive_density |
struct-passive-voice | structural | medium | human |  |
struct-physical-tells | structural | medium | human |  |
struct-previous-version | structural | medium | human |  |
struct-promotional | structural | medium | human |  |
struct-punchy-closure | structural | medium | human |  |
struct-rather-than | structural | medium | human | rather_than |
struct-rule-of-three | structural | medium | advisory |  |
struct-self-promotion | structural | medium | human | self_promotion |
struct-sentence-length-variance | structural | medium | advisory | sentence_length_variance |
struct-sentence-start-repetition | structural | medium | advisory | sentence_start_repetition |
struct-simile-adverb | structural | medium | human |  |
struct-subject-loops | structural | medium | advisory |  |
struct-synonym-cycling | structural | medium | human |  |
struct-system-tour | structural | medium | human |  |
struct-temperature-emotion | structural | medium | human |  |
struct-template-headings | structural | medium | advisory | template_headings |
struct-transformation-chains | structural | medium | human |  |
struct-transition-glue | structural | medium | human |  |
struct-transition-repetition | structural | medium | advisory | transition_repetition |
struct-treadmill-prose | structural | medium | advisory | treadmill_prose |
struct-tricolon-density | structural | medium | advisory | tricolon_density |
struct-triplet-overlap | structural | medium | human |  |
struct-type-definition | structural | medium | human |  |
struct-uniform-sentence | structural | medium | advisory |  |
struct-unsourced-precision | structural | medium | human | unsourced_precision |
struct-vague-association | structural | medium | human |  |
struct-weak-verbs | structural | medium | human |  |
struct-wisdom-sandwich | structural | medium | human |  |
struct-because-fragments | structural | low | human |  |
fmt-compound-hyphen | formatting | medium | advisory | fmt_compound_hyphen |
fmt-curly-quotes | formatting | medium | deterministic | fmt_curly_quotes |
fmt-em-dash | formatting | medium | deterministic | fmt_em_dash |
fmt-emoji-bullets | formatting | medium | deterministic | fmt_emoji_bullets |
fmt-emojis | formatting | medium | deterministic | fmt_emojis |
fmt-exclamation | formatting | medium | advisory | fmt_exclamation |
fmt-inline-header | formatting | medium | deterministic | fmt_inline_header |
fmt-semicolon | formatting | medium | advisory | fmt_semicolon |
fmt-title-case | formatting | medium | deterministic | fmt_title_case |
chatbot-certainly-absolutely | chatbot | medium | deterministic |  | Certainly! / Absolutely!
chatbot-cutoff-disclaimers | chatbot | medium | deterministic |  | While details are limited based on available information
chatbot-great-question | chatbot | medium | deterministic |  | Great question!
chatbot-hope-helps | chatbot | medium | deterministic |  | I hope this helps!
chatbot-let-me-know | chatbot | medium | deterministic |  | Let me know if you have questions!
mechanism-causality | mechanism | medium | advisory | mechanism_causality |
mechanism-impact | mechanism | medium | advisory | mechanism_impact |
mechanism-importance | mechanism | medium | advisory | mechanism_importance |
mechanism-superiority | mechanism | medium | advisory | mechanism_superiority |
"""

# Weight of a severity; score bands (least score, name); literal corrections
WEIGHTS = {"high": 8, "medium": 4, "low": 2}
BANDS = ((85, "low"), (65, "moderate"), (40, "high"), (0, "very high"))
CORRECTIONS = {"utilize": "use", "robust": "reliable", "in order to": "to", "due to the fact that": "because", "at this point in time": "now"}
PROFILES = {"general": (), "technical": ("general",), "fiction": ("general",), "social": ("general",), "marketing": ("general",)}
#: Rules that a profile leaves out although it extends general.
LEFT_OUT = {"technical": ("vocab-robust", "vocab-significant")}


class Rule(NamedTuple):
    rule_id: str
    category: str
    severity: str
    review: str
    detector: str
    text: str
    ordinal: int

    @property
    def signal(self) -> str:
        return "strict" if self.review == "deterministic" else "advisory"

    @property
    def weight(self) -> int:
        return WEIGHTS[self.severity]


RULES = [Rule(*[part.strip() for part in line.split("|", 5)], n) for n, line in enumerate(_TABLE.strip().splitlines())]


def closure(profile: str) -> tuple[str, ...]:
    """A profile and all that it extends; unknown names and cycles are errors."""
    found: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name not in PROFILES:
            raise ValueError(f"no profile {name}")
        if name in above:
            raise ValueError(f"profile {name} extends itself")
        if name not in found:
            found.append(name)
            for parent in PROFILES[name]:
                visit(parent, (*above, name))

    visit(profile, ())
    return tuple(found)


def profiles_of(rule: Rule) -> tuple[str, ...]:
    """Vocabulary belongs to named profiles, the rest to all."""
    if rule.category in ("vocabulary", "phrase", "filler"):
        return tuple(p for p in PROFILES if rule.rule_id not in LEFT_OUT.get(p, ()))
    return ("*",)


def active(profile: str) -> list[Rule]:
    """Rules of a profile: those for all, and those for it; one that it extends lends what it does not leave out."""
    names = set(closure(profile))
    return [r for r in RULES if ("*" in profiles_of(r) or names & set(profiles_of(r))) and r.rule_id not in LEFT_OUT.get(profile, ())]


def inflections(word: str) -> list[str]:
    """A word and, if it is one alphabetic token, its regular forms."""
    if not word.isalpha():
        return [word]
    stem = word.removesuffix("e")
    return list(dict.fromkeys([word + s for s in ("", "s", "es", "ed", "d", "ing", "r", "st")] + [stem + "ing", stem + "ed"]))


def _edges(text: str, inner: str) -> str:
    left = r"\b" if re.match(r"\w", text) else r"\B"
    right = r"\b" if re.search(r"\w$", text) else r"\B"
    return left + inner + right


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 '_-])", r"\\\1", text)


def pattern(rule: Rule) -> str | None:
    """One regular expression for a lexical rule, for engines with ASCII classes and without lookaround; None if it has none."""
    if rule.category not in ("vocabulary", "phrase", "filler", "chatbot") or not rule.text:
        return None
    if rule.category == "vocabulary" and "/" not in rule.text:
        forms = sorted(inflections(rule.text), key=len, reverse=True)
        return r"(?i)\b(?:" + "|".join(forms) + r")\b" if len(forms) > 1 else "(?i)" + _edges(rule.text, _escaped(rule.text))
    parts = []
    for part in (p.strip() for p in rule.text.split(" / ")):
        inner = r"\W?\w+".join(_escaped(p) for p in part.split("[X]"))
        parts.append(_edges(part.replace("[X]", "x"), inner))
    return "(?i)(?:" + "|".join(parts) + ")"


def words_in(text: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", text.lower())


def waits_for(rule: Rule) -> list[str]:
    """Lower-case words of which a text must hold one, whole, to match the rule: a cheap test before the expression."""
    if rule.category == "vocabulary" and "/" not in rule.text and rule.text.isalpha():
        return inflections(rule.text)
    return [max(words_in(part.split("[X]")[0]), key=len) for part in rule.text.split(" / ")]


def heads(rule: Rule) -> str:
    """Letters and digits of which each match of a lexical rule begins with one; none if some match may begin with another sign."""
    first = {part.strip()[0] for part in rule.text.split(" / ")}
    return "".join(sorted(first)) if all(c.isascii() and c.isalnum() for c in first) else ""


def phrases(rule: Rule) -> list[str]:
    """Lower-case strings of which a text must hold one to match a rule of phrases; none for rules of single words.

    A phrase is matched sign by sign, so its longest word alone, which may be as common as ``that``, need not send a text to the
    expression."""
    single = rule.category == "vocabulary" and "/" not in rule.text
    return [] if single else [p.split("[X]")[0].strip().lower() for p in rule.text.split(" / ")]


def needles(rule: Rule) -> list[str]:
    """Lower-case strings of which a text must hold one to match the rule, for engines without word sets."""
    if rule.category == "vocabulary" and rule.text.isalpha():
        return [rule.text.lower().removesuffix("e")]
    return [re.split(r"\[", p)[0].strip().lower() for p in rule.text.split(" / ")]
