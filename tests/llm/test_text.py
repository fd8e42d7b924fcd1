"""Repeated lines, main body, template residue and cut text."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import censor, lines, mainbody, repeats, templates

SCHEMA = "article_id long, url_id long, title string, content string"


def articles(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def urls(spark, rows):
    return spark.createDataFrame(rows, "url_id long, hostname string")


def test_repeated_lines_against_brute_force(spark):
    rng = np.random.default_rng(1)
    shared = ["© 2024 Site. All rights reserved.", "Back to top", "STRASSE 7", "Straße", "12 | 34", "", "Teilen ·"]
    rows, host = [], {}
    for i in range(1, 61):
        host[i] = f"h{i % 3}"
        picked = [shared[j].upper() if rng.random() < 0.3 else shared[j] + " " * int(rng.integers(3)) for j in rng.permutation(len(shared))[: int(rng.integers(7))]]
        rows.append((i, i, None, "\n".join([f"Own line {chr(97 + i % 26)}{chr(97 + i // 26)}", *picked, *picked[:1]]) + "\r"))
    rows += [(100, None, "t", shared[0]), (101, 999, "t", shared[0]), (102, 1, "t", None), (103, 1, "t", ""), rows[0]]
    skip = {3, 6}
    found = repeats.repeated_lines(articles(spark, rows).withColumn("hostname", F.lit("clash")), urls(spark, list(host.items()) + [(500, None)]), spark.createDataFrame([(x,) for x in skip], "article_id long"))
    seen = defaultdict(set)
    places = []
    for a, u, _, c in dict.fromkeys(rows):
        if c is None or u not in host or a in skip:
            continue
        for n, line in enumerate(c.split("\n"), 1):
            key = re.sub(r"[\W\d_]", "", line).upper()
            if key:
                seen[host[u], key].add(a)
                places.append((a, n, host[u], key))
    expected = {(a, n) for a, n, h, k in places if len(seen[h, k]) >= 8}
    assert expected and {(r.article_id, r.line_no) for r in found.collect()} == expected
    clean = {r.article_id: r for r in repeats.without_repeated(articles(spark, rows[:-1]), found).collect()}
    assert clean[102].content is None and clean[103].content == "" and clean[1].removed == sum(a == 1 for a, _ in expected)
    assert all(not (set(range(1, 99)) & {n for a, n in expected if a == i}) or clean[i].content != r[3] for i, r in enumerate(rows[:60], 1))


def test_repeated_lines_of_one_hot_source_and_empty_tables(spark):
    rows = [(i, 1, None, "Legal notice\nBody " + "abcdefghij"[i % 10] * (i % 7 + 1)) for i in range(400)]
    found = repeats.repeated_lines(articles(spark, rows), urls(spark, [(1, "hot")]))
    assert found.where("line_no = 1").count() == 400
    assert repeats.repeated_lines(articles(spark, []), urls(spark, [])).count() == 0


@pytest.mark.parametrize(
    "line, kind",
    [
        ("Home   Events   Careers", lines.FURN), ("Careers › Academics › From Here: a new", lines.FURN), ("  Back  to  top", lines.FURN), ("ADMISSIONSRESEARCHDIRECTORY", lines.FURN),
        ("Cookie settings: X and 7 partners would like your consent", lines.FURN), ("The survey asked students how often they accept cookie banners without reading them.", lines.STORY),
        ("The privacy policy of the app was shortened to 9 words.", lines.STORY), ("You may also like »", lines.BLOCK), ("Von der Redaktion X", lines.BY), ("By Ann Lee, The Ledger!", lines.BY),
        ("Tags: a, b", lines.FURN), ("10/4 – Lecture: X, Hall 3", lines.FURN), ("\xa0", lines.BLANK), ("Weather in X: 22 degrees, Y radar", lines.FURN), ("A team found that the sea, once calm, rose.", lines.STORY), ("Careers › Media contacts › Can a buoy help?", lines.FURN),
    ],
)
def test_class_of_a_line(line, kind):
    assert lines.local_class(lines.normal(line)) == kind


def test_block_of_other_stories_ends_where_the_story_goes_on():
    page = ["Why Zorblat matters", "Zorblat, says Ann Quill, changes how towns plan their roads.", "Most read on X", "Grant backs Vexmore – 4 min read", "Vexmore will open in spring, its founders said on Monday.", "The next phase of Zorblat will add nine sites, Ann Quill says.", "Back to top"]
    assert mainbody.furniture("Why Zorblat matters", page) == [False, False, True, True, True, False, True]


def test_main_body_edges(spark):
    long = "Sentence about Zorblat, long and plain. " * 20_000
    rows = [(1, 1, None, None), (2, 1, "t", ""), (3, 1, "t", "\n \n"), (4, 1, "t", long + "\nBack to top"), (5, 1, "t", "Back to top"), (5, 1, "t", "Back to top")]
    got = {r.article_id: r for r in mainbody.main_bodies(articles(spark, rows)).collect()}
    assert got[1].body is None and got[2].body == "" and got[4].body == long and got[5].body == ""
    off = [(r.article_id, r.line_no) for r in mainbody.off_lines(articles(spark, rows), spark.createDataFrame([(9,)], "article_id long")).collect()]
    assert sorted(off) == [(4, 2), (5, 1), (5, 1)] and mainbody.off_lines(articles(spark, [])).count() == 0


STORY = "The model behind Zorblat flagged nine of ten cases, and Ann Quill confirmed most of them by hand. " * 4
RESIDUE = {
    1: ("t", "404 Not Found\nThe page /a/1 could not be found on this server."), 2: ("t", "Please enable JavaScript to view this page."), 3: ("t", STORY + "{{ post.title }}"),
    4: ("[Insert title here]", STORY), 5: ("t", "Vestra dolor morit sit amet, Ponte culpo lorem sit bena dolor. Amet ipsum lorem dolor sit."), 6: ("t", "Home   Events\nAccess denied\nYou do not have permission to view /x on this server. Reference 12."),
    7: ("t", STORY + "\nSample paragraph. Sample paragraph."), 8: ("Erreur 404", "La page zou est introuvable."), 9: ("t", "Veuillez activer JavaScript pour afficher zou."), 10: ("TK headline TK", None),
}
WHOLE = {
    20: ("Page not found: how Zorblat rescues lost archives", STORY), 21: ("The {curly} grammar of Zorblat", STORY), 22: ("t", STORY + "The set {x, y, z} is small, see [1] and [2]."), 23: ("t", None), 24: (None, ""),
    25: ("t", STORY + "\nA page that was not found in the archive may still sit on tape, Ann Quill said."), 26: ("Lorem who? Zorblat on the history of dummy type", STORY), 27: ("t", STORY + "Ann marks passages with the letters TK and hates it."),
    28: ("t", STORY + "The award is worth $12 million, of which $1,920 goes to students."), 29: ("t", "Short but whole."),
}


def test_residue(spark):
    rows = [(i, 1, *v) for i, v in (RESIDUE | WHOLE).items()]
    got = [r.article_id for r in templates.residue(articles(spark, rows + rows[:2]).withColumn("template", F.lit("clash"))).collect()]
    assert sorted(got) == sorted(RESIDUE)
    assert templates.residue(articles(spark, [])).count() == 0


def test_residue_does_not_depend_on_what_else_a_task_holds(spark):
    said = ["Page not found", "Page not loading", "Error 404", "Error 17b", "Error alpha", "Error beta", "Access denied", "Access granted: loading", "Loading", "1a 2b unavailable", "3c 4d unavailable"]
    a = articles(spark, [(i, 1, None, said[i % len(said)]) for i in range(44)])
    one = {tuple(r) for r in templates.residue(a.coalesce(1)).collect()}
    each = {tuple(r) for r in templates.residue(a.repartition(44, "article_id")).collect()}
    two = {tuple(r) for r in templates.residue(a.repartition(2, F.rand(5))).collect()}
    assert one == each == two
    assert {0, 11, 22, 33} <= {i for i, _ in one} and not {1, 12} & {i for i, _ in one}


def test_prefix_tree_merges_templates():
    tree = templates.Tree()
    for x in ("alpha", "beta", "gamma"):
        g = tree.add(templates.tokens(f"You have no right to see {x} on this site 17"))
    assert " ".join(g[0]) == "you have no right to see <*> on this site <n>" and g[1] == 3
    assert len(tree.leaves) == 1 and tree.add(["other"]) is not g


def test_endings(spark):
    want = {
        "It ends here.": "stop", "It ends “a work in progress...”": "stop", "Done. (12 sources)": "stop", "It was. Then it bro": "open", "It was. Then it...": "mark", "It was. Then it bro […]": "mark", "It was. Then […]…": "mark",
        "- one\n- two": "list", "A headline on trees": "single", "It goes on and": "open", None: None, "": None, " \n": None, "It was. (19 sou": "open", "Cut by bytes. The las�": "mark",
    }
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r.v: r.e for r in df.select("v", censor.ending(F.col("v")).alias("e")).collect()} == want


def test_maximum_likelihood_finds_the_law_behind_a_limit():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(5.5, 0.5, 40_000)).astype(int) + 1
    n, counts = np.unique(np.minimum(x, 300), return_counts=True)
    cut = np.where(n == 300, counts, 0)
    mu, sd = censor.fit_censored(n.astype(float), (counts - cut).astype(float), cut.astype(float))
    assert abs(mu - 5.5) < 0.02 and abs(sd - 0.5) < 0.02
    import pandas as pd

    found = censor.limits(pd.DataFrame({"n": n, "all": counts, "unended": np.where(n == 300, counts, 1), "maybe": 0}))
    assert list(found["n"]) == [300] and found["posterior"].iloc[0] > 0.9


def test_the_fitted_law_tells_headlines_from_sentences_cut_by_a_limit(spark):
    """Single sentences without a stop: only what stands at its own source's limit is cut, and only if laws are fitted."""
    rng = np.random.default_rng(3)
    words = lambda n: ("the river rose again " * 60)[: int(n)].rstrip() or "x"
    rows = [(i, 1, words(np.exp(rng.normal(3.9, 0.25))) + "z", None) for i in range(400)]  # headlines of a source without a limit
    rows += [(400 + i, 1, "h" * 89 + "z", None) for i in range(2)]  # as long as the other source's limit
    for i in range(300):
        text = "t" * int(np.exp(rng.normal(4.3, 0.4)))
        rows.append((1000 + i, 2, text[:90] if len(text) > 89 else text + ".", None))
    s = spark.createDataFrame(rows, "analysis_id long, article_id long, claude_summary string, openai_summary string")
    a, u = spark.createDataFrame([(1, 1), (2, 2)], "article_id long, url_id long"), urls(spark, [(1, "free"), (2, "limited")])
    cut = {r[0] for r in rows if r[1] == 2 and len(r[2]) == 90 and r[2][-1] == "t"}
    assert len(cut) > 50 and {r.analysis_id for r in censor.judged(s, a, u).where("cut").collect()} == cut
    assert censor.judged(s, a, u, fitted=False).where("cut").count() == 0


def test_cut_values(spark):
    whole, cut = "The piece names a town. It ends well.", "The piece names a town. It ends in the mid"
    rows = [(i, i % 5, cut if i % 2 else whole, None if i % 3 else "A list of trees") for i in range(60)] + [(60, 77, cut, ""), (61, None, whole, "- a\n- b")]
    s = spark.createDataFrame(rows, "analysis_id long, article_id long, claude_summary string, openai_summary string").withColumn("source", F.lit("clash"))
    a = spark.createDataFrame([(i, i) for i in range(5)], "article_id long, url_id long")
    judged = censor.judged(s, a, urls(spark, [(i, f"h{i % 2}") for i in range(5)]))
    got = {(r.analysis_id, r.field) for r in judged.where("cut").collect()}
    assert got == {(i, "claude_summary") for i in [*range(1, 60, 2), 60]}
    by = {(r.source, r.field): r.share for r in censor.cut_by_source(judged).collect()}
    assert by["h0", "openai_summary"] == 0 and 0.4 < by["h0", "claude_summary"] < 0.6 and by[None, "claude_summary"] == 0.5
    assert censor.judged(s.limit(0), a, urls(spark, [])).count() == 0


# a short whole story in each of twelve languages, none of which may be taken for filler or a message
LANGUAGES = {
    "zh": "周二上午，市议会以七票对四票通过了新的公交线路计划。市长表示，施工将于明年春天开始，预计两年内完成。居民们对票价上涨表示担忧。", "ja": "市は火曜日、川沿いの古い橋を来年春までに建て替えると発表した。費用は約三億円で、工事の間は臨時の渡し船が運航される。",
    "uk": "Міська рада ухвалила новий бюджет у вівторок після тривалих дебатів. Найбільше коштів отримають школи та лікарні району.", "fi": "Kaupunginvaltuusto hyväksyi tiistaina uuden talousarvion pitkän keskustelun jälkeen. Eniten rahaa saavat koulut.",
    "tr": "Belediye meclisi salı günü uzun bir tartışmanın ardından yeni bütçeyi kabul etti. Okullar ve hastaneler öncelikli olacak.", "ar": "وافق مجلس المدينة يوم الثلاثاء على الميزانية الجديدة بعد نقاش طويل. وستحصل المدارس والمستشفيات على أكبر حصة من الأموال.",
    "pl": "Rada miasta przyjęła we wtorek nowy budżet po długiej debacie. Najwięcej pieniędzy otrzymają szkoły.", "ko": "시의회는 화요일 오랜 토론 끝에 새 예산안을 통과시켰다. 학교와 병원이 가장 많은 지원을 받게 된다.",
    "el": "Το δημοτικό συμβούλιο ενέκρινε την Τρίτη τον νέο προϋπολογισμό μετά από μακρά συζήτηση.", "hi": "नगर परिषद ने मंगलवार को लंबी बहस के बाद नया बजट पारित किया। स्कूलों को सबसे अधिक धन मिलेगा।",
    "la": "Consilium urbis die Martis novum rationarium probavit. Scholae plurimum pecuniae accipient.", "en": "The council passed a new budget on Tuesday after a long debate. Schools get most of the money.",
}


def test_stories_of_any_language_are_kept(spark):
    said = list(LANGUAGES.values())
    rows = [(i, i, "News", said[i % len(said)]) for i in range(len(said))]
    u = urls(spark, [(i, f"h{i}") for i in range(len(said))])
    assert templates.residue(articles(spark, rows), u).count() == 0
    assert templates.residue(articles(spark, rows)).count() == 0


UNLISTED = "Deze pagina {} bestaat hier niet meer en komt ook niet terug"


def test_templates_are_judged_by_their_spread(spark):
    """A message in words that no list holds is found by its spread over hosts; without merging or hosts it is not."""
    names = ["zorblat", "vexmore", "quill", "tandem", "orchid", "basalt", "meridian", "cobalt"]
    rows = [(i, i, f"Story {names[i]}", UNLISTED.format(names[i])) for i in range(8)]
    rows += [(20 + i, 20 + i, f"{names[i]} opens", f"{names[i]} was opened by the mayor of a small town on day {i}.") for i in range(2)]  # two pages are too few
    rows += [(30 + i, 30 + i, f"{names[i]} speaks", STORY + "\n" + UNLISTED.format(names[i])) for i in range(8)]  # a story that quotes it
    a, u = articles(spark, rows), urls(spark, [(i, f"h{i % 5}") for i in range(40)])
    assert {r.article_id for r in templates.residue(a, u).collect()} == set(range(8))
    assert templates.residue(a, u, agree=1.01).count() == 0
    assert templates.residue(a).count() == 0
    one_site = urls(spark, [(i, "h") for i in range(40)])
    assert templates.residue(a, one_site).count() == 0


def test_message_among_other_stories_and_thin_filler(spark):
    block = "More from Zunder\nWhat Zorblat teaches us about stones\n{}\n© 2021 Zunder. All rights reserved."
    rows = [(1, 1, "Ann Quill opens Zorblat", "Ann Quill opens Zorblat\n" + block.format("Warning: Undefined index: zorblat in template on line 12")), (2, 2, "Ann Quill opens Zorblat", "Ann Quill opens Zorblat\n" + block.format("Vexmore opens a laboratory"))]
    rows += [(3, 3, "t", "Lidero tenim volupe vestra volupe varo nulliqua vestra. Amet ralta volupe."), (4, 4, "t", "El dolor de los vecinos, sit in de la plaza, fue largo y tranquilo en todo momento.")]
    assert {r.article_id for r in templates.residue(articles(spark, rows), urls(spark, [(i, f"h{i}") for i in range(5)])).collect()} == {1, 3}


def test_templates_whose_first_words_vary(spark):
    lines = [(f"{x} is gone for good and will stay so", 1) for x in ("alpha", "beta", "gamma", "delta")]
    assert {t for _, t in templates.grown(lines, True)} == {"<*> is gone for good and will stay so"} and {t for x in lines for _, t in templates.grown([x], False)} == {x for x, _ in lines}
    assert templates.judged("<*> is gone", 4, 0b111, 0b111) == ("message", True) and templates.judged("<*> is gone", 4, 0b11, 0b111) == (None, False) and templates.judged("<*> <*>", 9, -1, -1) == (None, False)
    rows = [(i, i, f"t{'abcdefgh'[i]}", f"{'abcdefgh'[i] * 5} is gone for good and will stay so") for i in range(8)]
    assert {r.article_id for r in templates.residue(articles(spark, rows), urls(spark, [(i, f"h{i}") for i in range(8)])).collect()} == set(range(8))


def test_a_leaf_is_grown_in_parts(spark):
    rows = [(i, i, f"t{'abcdefgh'[i % 8]}", UNLISTED.format(f"{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8]}")) for i in range(64)]
    mined = templates.mined(articles(spark, rows))
    u = urls(spark, [(i, f"h{i % 5}") for i in range(64)])
    whole = {tuple(r) for r in templates.line_verdicts(mined, u).collect()}
    parts = {tuple(r) for r in templates.line_verdicts(mined, u, most=5).collect()}
    assert whole == parts and len(whole) == 64 and {v for _, v, _ in whole} == {"message"}


SITE = ["Zunder Post writes for all who live by the river and beyond it.", "What our readers pay keeps Zunder Post alive for yet another year.", "Every word on this page was set by hand in the print shop of Zunder Post."]
WORDS = "amber basalt cobalt dahlia ember fjord garnet hazel indigo juniper krill lichen".split()


def _site_pages(n, site=SITE):
    rows = []
    for i in range(n):
        w = WORDS[i % len(WORDS)].capitalize() + chr(97 + i // len(WORDS))
        own = [f"{w} has grown by {i} percent, says Ann {w}son of the harbour office, who counted it all over again in {w} last week." + f" Nobody in {w} had thought so." * (i % 3 + 1) for _ in range(1)]
        rows.append((i, i, f"{w} grows again", "\n".join([site[i % 3], *own, f"The office of {w} will count again in spring, when the ice on the river is gone and the boats can pass.", *[x for j, x in enumerate(site) if j != i % 3]]) + "\n" + f"A {w} made of clay stood by the door while the people of the town, old and young, looked on for hours without a word. " * 4))
    return rows


def test_lines_of_the_site_are_found_without_any_listed_word(spark):
    """The statistic over pages gives the link density: without it, or without the discount, the site's prose stays."""
    from newsloom.llm import sitelines

    rows = _site_pages(24)
    a, u = articles(spark, rows), urls(spark, [(i, "zunder") for i in range(24)])
    keyed = sitelines.keyed(a, u)
    want = {(i, n) for i, _, _, c in rows for n, x in enumerate(c.split("\n"), 1) if x in SITE}
    for most in (1_000_000, 0):  # keys sent, and keys joined
        known = sitelines.Known(keyed, most=most)
        assert {tuple(r) for r in mainbody.off_lines(a, None, known).collect()} == want
    assert mainbody.off_lines(a).count() == 0


def test_link_density_decides(monkeypatch):
    lines_of_page = [SITE[0], "Amber has grown, says Ann Amberson, and Nobody knows why.", "It is amber all the same, and the river is gone."]
    assert mainbody.furniture("Amber grows", lines_of_page, None, [True, False, False]) == [True, False, False]
    plain_points = mainbody.points
    monkeypatch.setattr(mainbody, "points", lambda line, density: plain_points(line, 0.0))
    assert mainbody.furniture("Amber grows", lines_of_page, None, [True, False, False]) == [False, False, False]


def test_copies_of_one_story_do_not_make_its_lines_the_sites(spark):
    """A story that fills the table, each copy edited in its longest line, keeps its lines."""
    from newsloom.llm import sitelines

    body = "The harbour of Amber will close for good, says Ann Amberson, who has run it for thirty years and more of them."
    rows = [(i, i, "Amber closes" + (" (update)" if i % 2 else ""), "\n".join([body, "The boats leave on Monday, and nobody knows where to.", f"{'x' * (i % 9 + 1)} " + "People of the town looked on without a word, old and young, for hours. " * 9])) for i in range(60)]
    known = sitelines.Known(sitelines.keyed(articles(spark, rows), urls(spark, [(i, "amber") for i in range(60)])))
    assert known.table.count() == 0
    none = sitelines.Known(sitelines.keyed(articles(spark, []), urls(spark, [])))
    assert none.table.count() == 0 and mainbody.off_lines(articles(spark, rows), None, none).count() == 0


def test_a_lone_title_between_furniture_is_dropped_and_lone_prose_kept():
    page = ["Zorblat changes how towns plan their roads, says Ann Quill.", "Zorblat began in spring, Ann Quill says, with nine towns, four rivers and one road. " * 4, "Back to top", "Students from Vexmore take Tandem to the finals – 7 min read", "Back to top", "The Annals of Basalt named the article one of its notable papers.", "Back to top"]
    assert mainbody.furniture("Zorblat changes roads", page) == [False, False, True, True, True, False, True]
