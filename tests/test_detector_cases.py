"""What each detector finds and leaves alone, in cases written by hand, apart from the patterns' own constants."""

import pytest

from inkspan.operators import detect

#: Detector: texts with how many findings each has.
CASES = {
    "fmt_em_dash": [("One — two", 1), ("One -- two – three", 2), ("1 - 2", 0), ("well-known", 0), ("", 0)],
    "fmt_curly_quotes": [("“a”", 2), ("it’s", 1), ("it's", 0), ('"a"', 0)],
    "fmt_emojis": [("Go 🚀 now ✅", 2), ("`🚀`", 0), ("Go now", 0), ('"🚀"', 0)],
    "fmt_emoji_bullets": [("- ✅ done\n- 🚀 go", 2), ("1. ✅ done", 1), ("done ✅", 0), ("- done", 0)],
    "fmt_inline_header": [("**Term:** text", 1), ("**Term** : text", 1), ("**bold** text", 0), ("`**a:**`", 0)],
    "fmt_exclamation": [("Wow! Yes!", 2), ('He said "wow!"', 0), ("`a!`", 0), ("'No!' they said.", 0)],
    "fmt_compound_hyphen": [("a highly-rated and newly-built house", 2), ("a well-built house", 0), ("`newly-built`", 0)],
    "chat_citation_leaks": [("See citeturn0search0.", 1), ("oai_citation here", 1), ("[attached_file:1]", 1), ("[1] cite", 0), ("turn0", 0), ("citation", 0)],
    "ai_url_parameters": [("https://a.b/?utm_source=chatgpt.com", 1), ("?utm_source=openai.com", 1), ("?utm_source=feed", 0), ("chatgpt.com", 0), ("utm_source=", 0)],
    "unfilled_placeholders": [("Dear [Your Name],", 1), ("[INSERT SOURCE URL]", 1), ("[TODO] and [TBD]", 2), ("`[TODO]`", 0), ("[link](x)", 0), ("[1]", 0)],
    "struct_link_text": [("[click here](http://a)", 1), ("[Learn More](b)", 1), ("[here](c)", 1), ("[the annual report](d)", 0), ("click here", 0), ("[here]", 0)],
    "engagement_bait": [("Have you ever wondered why?", 1), ("Picture this: rain.", 1), ("Let's be honest.", 1), ("Have you ever been to Rome?", 0), ("The picture shows it.", 0), ("An honest answer.", 0)],
    "template_headings": [("# Introduction\nx", 1), ("## Next steps\nx", 1), ("### Why the plan matters\nx", 1), ("Introduction\nx", 0), ("# Rain in May\nx", 0), ("The overview is here.", 0)],
    "self_promotion": [("We are proud of it.", 1), ("An industry-leading tool.", 1), ("Trusted\nby all.", 1), ('They call it "industry-leading".', 0), ("It matches the industry-leading baseline.", 0), ("A leading question.", 0), ("'world-class' they say", 0)],
    "rather_than": [("It is hype rather than substance.", 1), ("Rain rather than snow fell.", 1), ("We use it rather than that.", 0), ("You should go rather than stay.", 0), ("I would rather go than stay.", 0)],
    "unsourced_precision": [("Adoption is 45% here.", 1), ("It hit 30 of 40 teams.", 1), ("It is 3x the norm.", 1), ("Roughly 45% agree.", 0), ("About all of them and then, quite far on, 45% agree.", 1), ("45% or so agree.", 0), ("According to Gartner 45% agree.", 0), ("We measured 45% here.", 0), ("The limit is 45%.", 0), ("# 45% here", 0), ("| 45% | x |", 0), ("> 45% here", 0), ("`45%`", 0), ("~45% agree", 0)],
    "social_reach_promise": [("It will boost your reach.", 1), ("You will go viral.", 1), ("The algorithm loves it.", 1), ("Reach for it.", 0), ("An algorithm sorts.", 0)],
    "struct_artificial_line_breaks": [("it ran\nand sat", 1), ("Done.\nnow", 0), ("it ran\nAnd sat", 0), ("it ran\n\nand", 0)],
    "mechanism_importance": [("This is crucial for all.", 1), ("A pivotal step.", 1), ("It was a crucial step, measured twice.", 0), ("It is crucial, says Gartner.", 0), ("It is crucial. The end.", 1), ("Crucial: 40% less.", 0)],
    "mechanism_impact": [("A dramatic change.", 1), ("It had an impact.", 1), ("It reduced cost by 40%.", 0), ("A study saw an impact.", 0)],
    "mechanism_causality": [("It leads to chaos.", 1), ("This causes pain.", 1), ("It leads to 30 runs.", 0), ("It causes pain, wrote Smith.", 0)],
    "mechanism_superiority": [("It is the best.", 1), ("A world-class tool.", 1), ("The best of 12 tests.", 0), ("The rest is fine.", 0)],
}


@pytest.mark.parametrize("key", sorted(CASES))
def test_detector(spark, key):
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES[key])], "doc_id long, text string").coalesce(1)
    found = [r.doc_id for r in detect.pattern_findings(frame, [key]).collect()]
    assert {t: found.count(i) for i, (t, _) in enumerate(CASES[key])} == dict(CASES[key])


def test_all_detectors_have_cases():
    assert set(CASES) == set(detect.BY_KEY)


def test_reach_promises_are_for_the_social_profile(spark):
    frame = spark.createDataFrame([(1, "It will boost your reach.")], "doc_id long, text string")
    key = detect.RULE_OF.get("social_reach_promise", "social_reach_promise")
    assert [detect.all_findings(frame, p).where(f"rule_id = '{key}'").count() for p in ("general", "technical", "social")] == [0, 0, 1]
