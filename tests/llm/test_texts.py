import random

import numpy as np
import pytest

from readloom.llm import mixing, packing, residue, tokens

R = random.Random(6)
D = "doc_id bigint, text string, source string, tokens string, part int, capacity int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2) for i, t, s in rows], D)


def text(n):
    return " ".join(R.choice(["court", "appeal", "the", "Überprüfung", "42", "reasons,", "décision"]) for _ in range(n))


# --- tokens ---------------------------------------------------------------------------------------------


def test_count_in_parts_is_exact():
    v = tokens.default_vocabulary()
    t = text(500) + "\n\n  " + "x" * 300 + " " + text(100) + "  double  spaces 's"
    whole = len(tokens.encoding(v).encode_ordinary(t))
    assert [tokens.count(t, v, p) for p in (1, 7, 100, 10**9)] == [whole] * 4
    assert tokens.count(None, v) == tokens.count("", v) == 0


# --- packing --------------------------------------------------------------------------------------------


def fits(rows, size, most):
    for d in {r.doc_id for r in rows}:
        mine = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.part)
        assert [r.part for r in mine] == list(range(len(mine)))
        assert sum(r.tokens for r in mine) == size[d]
        assert [r.first_token for r in mine] == [sum(x.tokens for x in mine[:k]) for k in range(len(mine))]
        assert len(mine) == max(1, -(-size[d] // most))
    filled, room = {}, {}
    for r in rows:
        filled[r.container] = filled.get(r.container, 0) + r.tokens
        assert room.setdefault(r.container, r.capacity) == r.capacity
    assert all(filled[c] <= room[c] for c in filled)
    return sum(filled.values()), sum(room.values()), filled, room


def test_packing(spark):
    rows = [(i, text(R.choice([1, 5, 20, 60, 150, 400])), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, text(5000), "s")]
    budgets = spark.createDataFrame([("small", 100), ("big", 400), ("mid", 200), ("none", None), ("bad", 0), ("big", 400)], "budget_name string, capacity int")
    v = tokens.default_vocabulary()
    size = {i: tokens.count(t, v) for i, t, _ in rows}
    got = packing.pack_documents(docs(spark, rows + rows[:30]), budgets, group_rows=150).collect()
    assert {r.scheme for r in got} == {"small", "mid", "big", "joint"}
    share = {}
    for scheme, most in (("small", 100), ("mid", 200), ("big", 400), ("joint", 400)):
        mine = [r for r in got if r.scheme == scheme]
        assert {r.doc_id for r in mine} == set(size)
        used, room, filled, rooms = fits(mine, size, most)
        share[scheme] = used / room
        if scheme == "joint":
            assert {c for c in rooms.values()} <= {100, 200, 400}
            assert all(filled[c] > {100: -1, 200: 100, 400: 200}[rooms[c]] for c in rooms)  # as small as its contents allow
        else:
            assert set(rooms.values()) == {most}
    assert min(share.values()) > 0.9
    report = {r.scheme: r.filled for r in packing.fill_report(packing.pack_documents(docs(spark, rows), budgets, group_rows=150)).collect()}
    assert report == pytest.approx(share)


def test_best_fit_takes_the_tightest_room():
    assert packing.best_fit([7, 6, 4, 3], [10]) == [0, 1, 1, 0]
    assert packing.best_fit([9, 5, 1], [5, 10]) == [0, 1, 0]
    container, capacity = packing.pack(np.array([3, 3, 3, 3]), [5, 12])
    assert capacity.tolist() == [12] and len(set(container)) == 1
    assert packing.pack(np.array([], np.int64), [5])[0].size == 0
    assert packing.pack(np.array([0, 0]), [5])[1].tolist() == [5]


def test_opening_weighs_what_is_to_come():
    assert packing.least_cost(3, 100, [4, 10]) == 10  # either can be filled: the larger one
    assert packing.least_cost(3, 4, [4, 10]) == 4  # 4 tokens in 10 cost more
    assert packing.least_cost(5, 5, [4, 10]) == 10


def test_fullest_equals_all_subsets():
    from itertools import combinations

    for _ in range(30):
        sizes = [R.randrange(1, 12) for _ in range(8)]
        for c, chosen in zip((5, 13, 30), packing.fullest(sizes, (5, 13, 30))):
            sums = {sum(x) for k in range(9) for x in combinations(sizes, k)}
            assert len(set(chosen)) == len(chosen) and sum(sizes[i] for i in chosen) == max(s for s in sums if s <= c)


def test_worst_containers_are_packed_again():
    # 10 + 10 in two large containers of 16; three of 7 are less.
    container, capacity = packing.pack(np.array([10, 4, 4, 3, 10]), [7, 16])
    filled = np.bincount(container, weights=[10, 4, 4, 3, 10])
    assert (filled <= capacity).all() and capacity.sum() <= 39
    for _ in range(40):
        sizes = np.array([R.randrange(0, 100) for _ in range(R.choice([1, 5, 60]))])
        container, capacity = packing.pack(sizes, [10, 30, 100])
        filled = np.bincount(container, weights=sizes, minlength=len(capacity))
        assert len(container) == len(sizes) and container.max() + 1 == len(capacity)
        assert (filled <= capacity).all() and all(filled[i] > {10: -1, 30: 10, 100: 30}[c] for i, c in enumerate(capacity))
        single = min((packing.pack(sizes, [100])[1].sum(),))
        assert capacity.sum() <= single


def test_packing_edges(spark):
    budgets = spark.createDataFrame([("a", 10)], "budget_name string, capacity int")
    assert packing.pack_documents(docs(spark, []), budgets).count() == 0
    assert packing.pack_documents(docs(spark, [(1, "a", "s")]), budgets.filter("capacity > 10")).count() == 0
    assert [r.doc_id for r in packing.pack_documents(docs(spark, [(None, "a", "s"), (1, "a", "s")]), budgets).collect()] == [1, 1]


# --- mixing ---------------------------------------------------------------------------------------------


def mix(spark, rows, weights, **more):
    return mixing.Mix(docs(spark, rows), spark.createDataFrame(weights, "source string, target_share double, max_repeats int"), **more)


def test_shares_and_limits(spark):
    rows = [(i, text(R.choice([3, 10, 30])), R.choice(["a", " A", "a "])) for i in range(2000)]
    rows += [(5000 + i, text(10), "B") for i in range(300)] + [(7000 + i, text(20), "c") for i in range(40)] + [(9000, text(5), None), (9001, text(5), "other"), (9002, None, "a")]
    m = mix(spark, rows + rows[:100], [("a", 0.5, 1), ("b", 0.3, 5), ("C", 0.2, 4), ("missing", 0.1, 3), (None, 0.3, 1), ("b2", None, 2)])
    chosen = m.selection().collect()
    assert len({r.doc_id for r in chosen}) == len(chosen)
    most = {"a": 1, "b": 5, "c": 4}
    assert all(1 <= r.copies <= most[r.source] for r in chosen)
    report = {r.source: r for r in m.report().collect()}
    assert set(report) == {"a", "b", "c", "missing"} and report["missing"].share == 0
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s].share - want) < 0.01
    assert sum(r.share for r in report.values()) == pytest.approx(1)
    # the mix is as large as the limits allow: some source is used up
    v = tokens.default_vocabulary()
    size = {s: sum(tokens.count(t, v) for _, t, x in rows if (x or "").strip().lower() == s) for s in most}
    assert any(report[s].tokens >= 0.97 * most[s] * size[s] for s in most)
    assert sorted(map(tuple, m.selection().collect())) == sorted(map(tuple, chosen))  # the same again


def test_rank_decides(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 4)
    # " a" is one token
    assert tokens.count(" a", tokens.default_vocabulary()) == 1
    rows = [(i, " a", "a") for i in range(1000)] + [(2000 + i, " a", "b") for i in range(100)]
    weights = [("a", 0.5, 1), ("b", 0.5, 2)]
    n = {r.source: r for r in mix(spark, rows, weights, size=150).report().collect()}
    assert (n["a"].documents, n["b"].documents, n["b"].most_copies) == (75, 75, 1)
    other = {r.doc_id for r in mix(spark, rows, weights, size=150, seed=1).selection().collect()}
    assert other != {r.doc_id for r in mix(spark, rows, weights, size=150).selection().collect()}
    whole = {r.source: r for r in mix(spark, rows, weights).report().collect()}
    assert (whole["a"].documents, whole["b"].documents, whole["b"].most_copies, whole["b"].tokens) == (200, 100, 2, 200)


@pytest.mark.parametrize("weight", [None, "part"])
def test_inclusion_frequencies(spark, weight):
    """60 sources hold alike documents under different ids: how often a document is taken is what its odds promise."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 60, 70, 80] * 12
    rows = [(1000 * s + i, " a" * n, f"s{s:03}", 1 + i % 4) for s in range(60) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, part int")
    w = spark.createDataFrame([(f"s{s:03}", 1 / 60, 1) for s in range(60)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(df, w, size=60 * 1600, weight=weight)
    odds = {r.doc_id: r["lambda"] for r in m.odds().collect()}
    expected = {i: odds[i] for i in range(len(sizes))}
    assert sum(p * n for p, n in zip(expected.values(), sizes)) == pytest.approx(1600, rel=0.01)
    if weight:
        assert expected[1] == pytest.approx(2 * expected[0]) and expected[3] == pytest.approx(4 * expected[0])
    else:
        assert expected[8] == pytest.approx(55 * expected[0]) and 0 < expected[0] < 0.01
    times = [0] * len(sizes)
    for r in m.selection().collect():
        times[r.doc_id % 1000] += 1
    by_odds = {}
    for i, p in expected.items():
        by_odds.setdefault(round(p, 4), []).append(times[i] / 60)
    # Pareto sampling keeps the odds to within a few points in small samples; the last document is one of thirty.
    assert all(abs(sum(f) / len(f) - p) < 0.06 for p, f in by_odds.items()), by_odds


def test_certain_by_size(spark):
    """Documents whose odds reach one are always taken; all are where all tokens are wanted."""
    rows = [(i, " a" * n, "a") for i, n in enumerate([1000, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1])]
    m = mix(spark, rows, [("a", 1.0, 1)], size=1005)
    assert {r.doc_id: round(r["lambda"], 9) for r in m.odds().collect()} == {0: 1.0} | dict.fromkeys(range(1, 11), 0.5)
    assert sum(r.tokens for r in m.selection().collect()) == 1005
    assert sum(r.tokens for r in mix(spark, rows, [("a", 1.0, 1)]).selection().collect()) == 1010


def test_many_sources_without_broadcast(spark, monkeypatch):
    rows = [(i, " a", f"s{i % 20}") for i in range(400)]
    weights = [(f"s{i}", 1 / 20, 1) for i in range(20)]
    want = sorted(map(tuple, mix(spark, rows, weights, size=100).selection().collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mix(spark, rows, weights, size=100).selection().collect())) == want and len(want) == 100


@pytest.mark.parametrize("name", ["p7_fill", "p8_shares"])
def test_equals_sql(spark, name):
    from readloom.llm import queries
    from tests.oracle import same

    same(spark, "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name])


def test_mixing_edges(spark):
    assert mix(spark, [], [("a", 1.0, 1)]).selection().count() == 0
    assert mix(spark, [(1, "x", "a")], []).selection().count() == 0
    assert mix(spark, [(1, "", "a")], [("a", 1.0, 1)]).report().first().documents == 0
    assert [tuple(r)[:2] for r in mix(spark, [(1, "x", "a")], [("a", 1.0, 3)]).selection().collect()] == [(1, "a")]


# --- residue --------------------------------------------------------------------------------------------

BODY = "Court of Appeal\n\n1. The judge found that Smith had acted in good faith and the appeal is dismissed with costs.\n\n"
CASES = [
    "Please enable JavaScript to view this judgment.",
    "Search | Home\n\nREQUEST TIMED OUT AFTER 187 SECONDS.\n\nRef f19d-86573",
    BODY + "Fehler 404: Entscheidung nicht gefunden.",
    '{"status":174,"detail":"document not available"}',
    "<html><title>410 Gone</title><body>Gone</body></html>",
    BODY + "16. XXXXXXXXXXXXXXXXXXX\n\nORDER",
    BODY + "16. ........................",
    "REASONS\n\nCulpa sint porro velit lorem tempor lorem ipsum quam aliqua sint labore vero amet lorem nemo aliqua.",
    "REASONS\n\n12. test test test test test test",
    "REASONS\n\nbaz foobar hjkl jkl; asdf test123 aaaa qqq asdf qwer",
    BODY + "Mustertext, bitte durch die Gründe ersetzen.",
    BODY + "The sum of {{ amount }} crowns.",
    BODY + "<<Docket No>> of the court",
    BODY + "Heard by [NAME OF APPELLANT] on [insert date of hearing]",
    BODY + "with costs of undefined crowns",
    BODY + "«MERGEFIELD Party1» appeals",
    BODY + "paid on DD/MM/YYYY to %COURT_NAME% and %%PARTIE%% and __AMOUNT__",
    "Decided by &lt;presiding judge&gt; and [object Object]",
    "Der Bescheid vom TT.MM.JJJJ war [bitte ergänzen]",
]
CLEAN = [
    None,
    "",
    BODY,
    BODY + 'The screenshot in evidence shows the words "404 - page not found", which Smith saw.',
    BODY + 'Clause 3 of the form still read "[insert amount]" when Smith signed it, and that blank was fatal.',
    BODY + "Le formulaire contenait encore la mention « [à compléter] », ce que Smith invoque.",
    BODY + "Im Formular war die Stelle „[bitte ergänzen]“ noch offen.",
    BODY + "The template of Smith used the marker ${amount}, and the invoice was printed with it filled in.",
    BODY + 'The field "{{client_name}}" is filled by the program. The word "undefined" in rule 3 means not defined.',
    BODY + "Exhibit 2 is a blank brochure containing only lorem ipsum, tendered by Smith to prove the layout.",
    BODY + 'The code asks users to "enable JavaScript"; Smith says that this breaches clause 2.',
    "[redacted], Appellant, and █████ v [...] of _____ and [name withheld], [geschwärzt] [anonymisé] [omitido]",
    "Le délai est prolongé de 114 jours.",
    "Judgment reserved.",
    "[12] Re Smith [1994] QAC 136, 12 {3} is not a field of 100%",
]


#: Wordings that stand neither in the tables nor, as a whole, in the lists.
UNSEEN = [
    "404 Not Found",
    "Error 404: the requested URL was not found on this server.",
    "JavaScript must be enabled in order to view this page.",
    "Your browser does not support JavaScript.",
    "You don't have permission to access this resource.",
    "Por favor, habilite JavaScript en su navegador",
    "Erreur 404 : page non trouvée",
    "Fehler 404 - Seite wurde nicht gefunden",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.",
    "Hier könnte Ihr Text stehen.",
    "[Name des Klägers]",
    "The sum of {{ " + "a very long description of the amount " * 5 + "}} is due.",
    "503 Service Unavailable",
    "HTTP Error 500: Internal Server Error",
    "Sorry, this page could not be found.",
    "The document has been moved or deleted.",
    "Access forbidden",
    "An unexpected error occurred. Please try again later.",
    "Your session has expired. Please log in again.",
    "Connection reset",
    "Die Datei konnte nicht geladen werden.",
    "Ein Fehler ist aufgetreten.",
    "Veuillez autoriser les cookies et activer JavaScript pour continuer.",
    "Une erreur s'est produite.",
    "El documento no existe",
    "Se ha producido un error.",
    "JavaScript appears to be disabled in your browser.",
    "This site won't work without JavaScript.",
    "Please turn on cookies and JavaScript.",
    "Skripte müssen aktiviert sein.",
    "Insert text here",
    "Dummy text",
    "Reasons to be supplied",
    "Platzhaltertext",
    "Texte provisoire",
    "Texto simulado",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore.",
    "qwerty asdf asdf qwerty",
    "Heard on [date of hearing] by [Nombre del juez]",
    "Costs of ${costs_total} to %RESPONDENT%",
    "{0} v {1}, judgment of [bitte einsetzen]",
]
#: Near misses: ordinary sentences with the same words.
UNSEEN_CLEAN = [
    "Smith was not found guilty of the second charge.",
    "The missing file was later found in the registry and its contents were read to the jury.",
    "Access to the land was denied by the respondent from May onwards, and no reason was given.",
    "The parties agreed that the service of the notice had failed because the address was wrong.",
    "The witness said the page could not be found in the exhibit bundle that Smith had handed up.",
    "The server was at the restaurant when the accident happened.",
    "His permit had expired and the connection to the mains had been lost.",
    "The expert explained that the program runs without scripts and sets no cookies on the device.",
    "Whether the defendant must enable users to refuse cookies is the question before us.",
    "The appellant was required to enter text here and there by hand, which took her an hour.",
    "The maxim de minimis non curat lex applies; in dubio pro reo does not.",
    "Res ipsa loquitur. Ex turpi causa non oritur actio.",
    "The test is whether the text is clear.",
    "Das Urteil wurde nicht angefochten.",
    "Le document est versé au dossier et n'est pas contesté.",
    "El recurso no fue admitido a trámite por extemporáneo.",
    "Section 404 of the Act was not found to apply.",
    "The plaintiff's session with the mediator timed out without agreement on costs.",
    "Set {3, 5, 7} and the set {2} were marked on the plan; see [Smith], [No 2] and [2004] QB 12.",
    "The price rose by 5% and 7% to $40 and $55; #3 and #4 were sold.",
    "x < Y AND y > Z in the formula of the expert",
    "Appeal dismissed.",
    "No order as to costs.",
    "The error was corrected.",
]


@pytest.mark.parametrize("t", CASES + UNSEEN)
def test_cases(t):
    fields, coverage, kinds = residue.judge(t)
    assert coverage >= 0.5 and (fields or kinds)


@pytest.mark.parametrize("t", [c for c in CLEAN + UNSEEN_CLEAN if c])
def test_clean(t):
    fields, coverage, kinds = residue.judge(t)
    assert coverage < 0.5 and not fields and not kinds


def test_coverage_decides():
    share = lambda t: residue.judge(t)[1]
    assert share("Access denied.") == 1 and share("12. Access denied.") == 1
    assert 0 < share("The witness told the court that her screen showed access denied for a moment.") < 0.5
    assert share("Page {{ n }} of many") == 1 and share("Page { n } of many") == 0
    # markers at any distance in a line, but not across lines, and each closing marker has one opening
    assert residue.judge("{{" + "x" * 100_000 + "}}")[0] and not residue.judge("{{ a\n}}")[0]
    assert residue.judge("{{ {{ b }}")[0] == ["{{ b }}"] and residue.judge("[" * 50_000 + "insert x]")[0] == ["[insert x]"]


def test_case_changes_nothing():
    for t in CASES[:4]:
        assert residue.judge(t.upper())[2] and residue.judge(t.lower())[2]
    assert residue.judge("İ" * 50 + "\n\nAccess denied.")[2] == ["error"]


def test_residue_frames(spark):
    rows = [(i, t, "s") for i, t in enumerate(CASES + CLEAN)] + [(500, CASES[0], "s"), (None, CASES[0], "s"), (700, "word " * 200_000 + "\n\nAccess denied.", "s")]
    df = docs(spark, rows)
    found = {r.doc_id for r in residue.judged(df).filter(residue.is_residue()).collect()}
    assert found == {*range(len(CASES)), 500, None, 700}
    kept = residue.clean_documents(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(len(CASES), len(CASES) + len(CLEAN)))
    assert residue.judged(docs(spark, [])).count() == 0 and residue.clean_documents(docs(spark, [])).count() == 0
