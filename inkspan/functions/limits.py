"""Limits, word lists and patterns that document-level measures and the findings made of them share."""

HEADING = r"(?m)^#{1,6}\s+[^\n]+\n"
# Limits of the measures, transitions, passive forms and adjectives that are none
SENTENCE_MIN_WORDS, SENTENCE_MIN, MEAN_MIN, SENTENCE_CV = 3, 5, 12.0, 0.30
PARAGRAPH_MIN_WORDS, PARAGRAPH_MIN, PARAGRAPH_CV = 30, 4, 0.25
OPENER_SENTENCES, OPENER_COUNT, OPENER_SHARE = 6, 3, 0.30
SIMILAR_WORDS, SIMILAR, SIMILAR_SHARED, DUPLICATE = 8, 0.60, 6, 0.90
TRANSITION_COUNT = 3
TRANSITIONS = (
    "in addition", "for instance", "for example", "in particular", "moreover", "furthermore", "additionally", "consequently", "subsequently", "nevertheless",
    "conversely", "accordingly", "hence", "thus", "therefore", "specifically", "notably", "importantly", "crucially", "essentially",
)
PASSIVE = (
    r"(?i)\b(?:am|is|are|was|were|be|been|being)(?:\s+(?:not|never|[a-z]+ly))?\s+([a-z][a-z]+ed|done|made|given|taken|seen|known|shown|found|held|kept|left|lost|meant|put|read|run|said|sent|set|told|thought|"
    r"understood|written|built|brought|bought|caught|chosen|drawn|driven|eaten|fallen|felt|gotten|gone|grown|heard|hidden|hit|led|paid|proven|sold|spent|spoken|spread|stolen|taught|thrown|won|broken|begun|cut)\b"
)
ADJECTIVES = (
    "mixed tired excited interested bored surprised worried concerned prepared involved related located connected designed expected required based limited combined committed dedicated focused satisfied pleased "
    "confused disappointed exhausted overwhelmed annoyed scared frightened alarmed fascinated puzzled shocked embarrassed accustomed crowded qualified specialized educated skilled trained organized established "
    "united blessed alleged designated determined documented entitled intended marked noted painted reserved situated stated supposed"
).split()
PASSIVE_SENTENCES, PASSIVE_COUNT, PASSIVE_SHARE = 6, 3, 0.35
STOP_WORDS = "a an and are as at be because but by for from has have in into is it of on or that the their this to was were will with".split()
HEADING_SMALL = "a an the and or but for nor so yet on in at to from of with by as is are was were be been it its this that these those".split()
# What a section's prose leaves out, lists of three, and names that keep their capitals in a heading
FENCE, COMMENT = r"(?s)```.*?```", r"<!--.{0,1000}?-->"
NO_PROSE_START = r"^(?:#|- |\* |[1-9]\.|\|)"
HEADING_LINE = r"(?m)^#{1,6}\s+[^\n]+$"
HEADING_WORD = r"[A-Za-z][A-Za-z'-]*"
HEADING_NAMES = "openai chatgpt codex javascript python json api html css http https gpt claude gemini kiro forgejo github oauth rfc kubernetes amazon visual transport".split()
