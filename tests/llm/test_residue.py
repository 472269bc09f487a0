import random

import pytest

from sievework.llm.residue import evidence, marked, residue

WORDS = "harbor violet ledger chimney parsley gasket meadow walnut ribbon cactus spindle orchard".split()


def sentence(rng):
    return f"The release adds a {rng.choice(WORDS)} {rng.choice(WORDS)} and removes the {rng.choice(WORDS)} that nobody used."


def found(spark, rows, **kw):
    return {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()}


# each found by itself: a variable in delimiters, repetition, dummy text
RESIDUE = [
    "Dear {{ first_name }},", "The release adds a ${title} gasket and removes it.", "Owner: __title__", "Please <YOUR NAME> the desk before noon arrives.", "[INSERT date HERE]", "(fill in product)", "<%= summary %>", "&lt;team&gt; met today at the old desk.",
    "Hi *|FNAME|*, welcome.", "Name: ________", "Signed ______", "{greeting} and welcome to {site}", "All <<amount>> of it.",
    "Lorem ipsum dolor sit amet consectetur.", "xxx xxx xxx xxx", "xxxxxxxxxxxx", "x.x.x.x.x.x.x", "text goes here text goes here text goes here text goes here", "- item one\n- item two\n- item three",
]
# parts of page templates: found where several texts repeat them
PAGES = [
    "404 Not Found", "Access denied.", "Error code: 502", "Your session has expired.", "Page introuvable", "Zugriff verweigert", "Acceso denegado", "HTTP 503", "TBD", "[no description yet]",
    "Please enable JavaScript to use this site.", "Loading... (requires JS)", "<noscript>Active JavaScript para ver esta página.</noscript>", "Timed out while fetching /a/b. Retry in 7 s", "The page you requested does not exist.",
]
FINE = [
    "", "ok", "see above", "done.", 'We renamed "{{ title }}" to "<YOUR name>" in the guide.', "Why did `TBD` reach readers?", "Visitors saw “503 Service Unavailable” for ten minutes.", "```\necho ${HOME}/x\nprint(f\"{name}\")\n```",
    "Call GET /v4/memos/{feed_id}/cards to read one.", "The page keeps working when JavaScript is switched off, because the server renders it.", "docket.get returns code 404 while the index is rebuilt.", "Access to the desk is denied by default.",
    "A linter fails the build if a page contains 'lorem ipsum'.", "None of them was null, undefined or N/A in the end.", "Use *bold* and _plain_ words, f(x) < 3 & y > 2, 50% off [1].", "Summary ....... 12",
    "Forbidden fruit is a phrase from Genesis.", "Unauthorized copies were sold at the market in 1911.", "Error 12 in the ledger was fixed by hand.", "Permission denied by the council, the bridge was never built.",
]


@pytest.mark.parametrize("alone", [True, False])
def test_cases(spark, alone):
    rng = random.Random(1)
    around = lambda t: t if alone else f"{sentence(rng)}\n\n{t}\n\n{sentence(rng)}"
    rows = [(k, around(t)) for k, t in enumerate(RESIDUE + FINE)] + [(900 + k, sentence(rng)) for k in range(40)] + [(None, "{{x}}"), (800, None), (0, around(RESIDUE[0]))]
    got = found(spark, rows)
    assert [(RESIDUE + FINE)[k] for k in got ^ set(range(len(RESIDUE)))] == []


@pytest.mark.parametrize("copies", [True, False])
def test_pages(spark, copies):
    """Parts of page templates are known by their repetition, over texts or over copies of a page."""
    rng = random.Random(3)
    text = lambda t: t if copies else f"{sentence(rng)}\n\n{t}\n\n{sentence(rng)}"
    rows = [(10 * k + c, text(t)) for k, t in enumerate(PAGES) for c in range(4)]
    plain = [(1000 + k, text(t)) for k, t in enumerate(FINE)]
    assert found(spark, rows + plain) == {k for k, _ in rows}


def test_two_parts_run_together(spark):
    rows = [(k, f"{sentence(random.Random(k))}\n502 Bad gateway\nNothing to show for that link") for k in range(4)] + [(9, "404 Bad gateway Nothing to show for that link")]
    assert 9 in found(spark, rows + [(20 + k, "Nothing to show for that link") for k in range(3)])


def test_slots_are_induced(spark):
    """What only looks like a variable, a default or a gap counts where other records hold words."""
    rng = random.Random(4)
    letters = [(k, f"Dear {rng.choice(WORDS)}, the {rng.choice(WORDS)} is ready.\nReviewer: {rng.choice(WORDS)}\nHello {rng.choice(WORDS)}, your order has shipped.") for k in range(80)]
    odd = ["Dear [First Name], the ribbon is ready.", "Reviewer: TBD", "Hello %s, your order has shipped.", "Dear , the walnut is ready.", "Reviewer: null"]
    lone = ["Colour of state: null", "They wrote %s at the gate.", "See [Old Harbor] for more."]
    rows = letters + [(200 + k, t) for k, t in enumerate(odd)] + [(300 + k, t) for k, t in enumerate(lone)]
    got = {(r.doc_id, r.why) for r in evidence(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(200 + k, "slot") for k in range(len(odd))}


def test_a_templates_own_variable_is_no_residue(spark):
    rng = random.Random(2)
    own = [(k, f"Route users by {{region}} and keep {rng.choice(WORDS)} in {rng.choice(WORDS)} order.") for k in range(60)]
    filled = [(100 + k, sentence(rng)) for k in range(40)] + [(200, "The release adds a {region} ledger and removes the ribbon that nobody used.")]
    assert found(spark, own + filled) == {200}


def test_parts_that_keep_company_with_messages(spark):
    pages = [(k, f"Error 50{k}\nJust a moment") for k in range(20)] + [(100, "Just a moment")]
    menus = [(200 + k, f"{WORDS[k % 12]} {k}\nHome") for k in range(30)] + [(300, "Error 501\nHome")]
    assert found(spark, pages + menus) == {k for k, _ in pages} | {300}


def test_neither_copies_nor_growth_hide_an_unfilled_field(spark):
    copied = [(k, "Please contact {owner} before noon today.") for k in range(30)]
    strong = [(200 + k, f"Send the ${{form}} to {a} and keep {b} in order.") for k, (a, b) in enumerate((a, b) for a in WORDS[:6] for b in WORDS[6:])]
    assert found(spark, copied + strong) == {k for k, _ in copied + strong}


def test_copies_of_a_sound_text_are_no_page(spark):
    article = "\n\n".join([*(sentence(random.Random(k)) for k in range(4)), "A browser was bought by one team in May."])
    rows = [(k, article) for k in range(8)] + [(100 + k, "The gadget wants a fresh browser") for k in range(6)]
    assert found(spark, rows) == set(range(100, 106))


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "{{x}} y", "a", 2)], "doc_id long, text string, kid string, unit int")
    assert [r.doc_id for r in residue(df).collect()] == [1]
    assert residue(df.limit(0)).count() == 0


def test_long_text_in_bounded_time(spark):
    text = "{" * 20000 + "a " * 50000 + "[" * 3000 + '"' * 3000 + "( " * 3000 + "{a" * 3000
    assert len(marked(text)) > 1000 and found(spark, [(1, text)]) <= {1}
