"""Residue in single texts and learnt over a table."""

import pytest

from verdigrade.llm import residue as rs


def kind(text):
    body = rs.without_code(text)
    if any(certain for _, _, certain in rs.slots(body)):
        return "placeholder"
    k, unknown = rs.page(body)
    return k if k and not unknown else None


@pytest.mark.parametrize(
    "text",
    [f"Fine text.\n\nOwner: {x}\n\nMore text." for x in ("{{ owner }}", "{{owner}}", "${owner}", "#{owner}", "%(owner)s", "<%= owner %>", "<<owner>>", "[[owner]]", "@@owner@@", "__OWNER__", "XX_OWNER_XX", "[your owner]", "[INSERT OWNER HERE]", "{% if owner %}")],
)
def test_placeholder(text):
    assert kind(text) == "placeholder"


@pytest.mark.parametrize("text", ["An unfilled `{{ owner }}` came up.", "Look:\n```\n{% if x %}{{ x }}{% endif %}\n```\nThis is a version.", "In <code>${RUN}</code> it stands.", "The interval is [0.4, 0.5] of 30 % and $5.", "~~~\n[your name]\n~~~\nA template."])
def test_shown_on_purpose(text):
    assert kind(text) is None and not list(rs.slots(rs.without_code(text)))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("Run review\n\nSample text goes here.\nxxxx xxxx xxx xxxxx.", "filler"), ("asdf asdf asdf jkl jkl.", "filler"), ("Blah blah blah blah, more blah to come.", "filler"),
        ("Type something meaningful in this section.\nReplace this paragraph before publishing.", "filler"), ("404 Not Found - Something went wrong on our side, try again in a few minutes. - Back to the start page", "error"),
        ("Menu\nRuns\nHelp\n500 Internal Server Error\nThe upstream server sent an invalid response.", "error"), ("Fehler 404\nDie angeforderte Seite gibt es auf diesem Server nicht.", "error"), ("Acceso denegado - La página solicitada no existe en este servidor.", "error"),
        ("Access denied Your session has ended, sign in again to continue. Reference number: run-bea5f", "error"), ("You need to enable JavaScript and cookies to run this app.\nSkip to content", "notice"),
        ("<noscript>Please turn on scripts in your browser settings.</noscript>", "notice"), ("Loading…\nThe viewer requires JavaScript before you continue.", "notice"), ("Activez JavaScript pour continuer.", "notice"),
        ("Skip to content\nSu navegador bloquea los scripts para continuar.", "notice"), ("Ea quis commodo nisi. Veniam ut do magna sed aliqua.", "filler"),
        ("Home | Reports | Sign in 502 Bad Gateway The page you are looking for could not be located on this server. Reference number: run-1", "error"),
    ],
)
def test_pages(text, want):
    assert kind(text) == want


@pytest.mark.parametrize(
    "text",
    [
        "The provider answered 404 Not Found for 3230 calls on Thursday, which the renderer counts as harness errors.", "Filler text such as lorem ipsum in the pack confused the model, so the team removed 12 cases.",
        "The HTML report needs JavaScript only for its charts; the JSON has the same 6769 rows.", 'The maintainer saw "502 Bad Gateway" in the log of run-1 for 13 minutes and then nothing.', "", "  ", "# Title", "Notes",
        "El navegador de la empresa bloquea los anuncios y abre el informe en otra ventana.", "Il est non moins utile qui plus est.",
        "The report was not found by the second annotator, who had asked for it on Monday and then again.",
    ],
)
def test_sound(text):
    assert kind(text) is None


def test_table(spark):
    rows = [(1, "<owner> passed the gate on Monday."), (2, "{team} passed the gate on Monday."), (3, "The <candidate> tag is used once here."), (4, "Owner: {baseline_score}"), (5, None), (6, ""), (None, "{{ x }}"), (7, "A $PATH is set."), (1, "<owner> passed the gate on Monday.")]
    rows += [(10 + i, f"404 Not Found\nThis place went fishing {i}.") for i in range(9)] + [(20, "This place went fishing 9."), (21, "This place is fine.\nThis place went fishing 2.\nThere is more to say about it.")]
    rows += [(30, "{{ x }} " + " ".join(f"word{chr(97 + i % 26)} one{chr(97 + i % 7)} two{chr(97 + i % 5)}" for i in range(200_000))), (31, "word. " * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kind string, key int")
    got = {r.doc_id: r.kind for r in rs.residue(df).collect()}
    assert got == {1: "placeholder", 2: "placeholder", 4: "placeholder", 30: "placeholder", **{10 + i: "error" for i in range(9)}, 20: "error"}
    left = {r.doc_id for r in rs.without_residue(df).collect()}
    assert left == {3, 5, 6, 7, 21, 31, None}
    assert rs.residue(df.limit(0)).count() == 0


def test_filled_siblings(spark):
    rows = [(1, "Owner: TBD"), (2, "Owner: Anna"), (3, "Report\nDear <recipient>, your run is scored."), (4, "Dear Anna, your run is scored."), (5, "Team: ____"), (6, "Team: wren"), (7, "Due: TBD\nDue: Monday"), (8, "See $PATH"), (9, "See the guide."), (10, "Cost: TBD credits"), (11, "Cost: 18.2 credits"), (12, "Name:{owner}"), (13, "Name:Anna"), (14, "$OWNER signed the release sheet"), (15, "Anna signed the release sheet")]
    rows += [(16, "Stage: [Name]"), (17, "The stage: it is over."), (18, "Lead: TBD"), (19, "Lead: TBD"), (20, "Head: TBD"), (21, "Head: TBD."), (22, "Dear <name>,"), (23, "Dear Anna,")]
    got = {r.doc_id for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1, 3, 5, 10, 12, 14, 22}


def test_repeated_pages(spark):
    lines = "\n".join(f"This place has a rule of its own about {w} that nobody else has." for w in ("tea", "rope", "salt", "corn", "silk", "wool"))
    rows = [(i, f"502 Bad Gateway\n{lines}\nSent to {i}.") for i in range(4)] + [(10 + i, f"Błąd 503\nStrona poszła na ryby {i}.\nWróci jutro.") for i in range(3)] + [(20, "Access denied\n<pre>trace 5</pre>\nPlease try again later.")]
    rows += [(30 + i, f"Report\n{lines}\nSent to {i}.") for i in range(4)] + [(40 + i, f"404 Not Found\n{lines}\nA note.") for i in range(3)] + [(50 + i, f"403 Forbidden\n{lines}\nA page.") for i in range(30)]
    got = {r.doc_id for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0, 1, 2, 3, 10, 11, 12, 20, *range(50, 80)}


def test_lines_are_counted_over_all_texts(spark):
    line, more = "The nightly suite was late again.", " ".join(f"Something {w} is told about the suite in this report." for w in ("new", "old", "red", "odd", "big", "sad"))
    rows = [(i, f"Not found\n{line}\nReference: x-{i}") for i in range(4)] + [(10 + i, f"Report {i}\n{line}\n{more}") for i in range(9)] + [(20, line)]
    rows += [(30 + i, "404 Not Found\nThe team went on with the older pack.") for i in range(3)] + [(40 + i, f"500 Internal Server Error\nOur hamsters rest {i}.") for i in range(3)]
    read = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in rs.residue(read.where("doc_id >= 10")).collect()}
    assert got == {40, 41, 42}
    assert 20 not in {r.doc_id for r in rs.residue(read).collect()}


@pytest.mark.parametrize(
    "mark",
    ["[Insert a short description of the main findings of this evaluation run and the owner here]", "{{ today() }}", "{{ x | default('a', true) }}", "{{ f({'a': 1}) }}", "{{ " + "long_" * 20 + "name }}", "<your " + "very " * 20 + "long name>", "${" + "long." * 20 + "name}", "{% if x % 2 == 0 and y in ['a', 'b', 'c'] and the_longest_name_of_all is not none and z %}", "<%= format(a > 1, 50 % 3) %>"],
)
def test_marks_of_any_length(mark):
    assert kind(f"Fine text.\n\nOwner: {mark}\n\nMore text.") == "placeholder"


def test_long_lines_are_told_apart_to_their_end(spark):
    same = " ".join(f"word{c}" for c in "abcdefghijklmnop" * 15)
    rows = [(1, f"{same} is owned by <anna> there."), (2, f"{same} is read under {{team}} here.")]
    assert len(same) > 1000 and rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_unclosed_marks_take_no_time():
    import time

    start = time.perf_counter()
    for opening in ("{{ a", "{% a ", "<% a", "[insert a ", "<your ", "[[a ", "<<a ", "@@a ", "{{ {a}", "__A"):
        list(rs.slots(opening * 2_000))
    assert time.perf_counter() - start < 20


def test_pages_are_read_to_their_end(spark):
    """Messages behind any number of lines that no label fits count as those before them."""
    own = "\n".join(f"Our {w} keeps the lights on at night." for w in ("cook", "baker", "smith", "miller", "tailor"))
    said = "404 Not Found\nThe page was not found.\nPlease try again later.\nSomething went wrong.\nThe server is down.\nAccess denied."
    assert rs.page(f"{own}\n{said}")[0] == "error" and len(rs.page(f"{own}\n{said}")[1]) == 5
    assert rs.page(f"{own}\n{own}\n{said}") == (None, None)
    rows = [(i, f"{own}\n{said}\nReference number: run-{i}") for i in range(3)]
    assert {r.doc_id for r in rs.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0, 1, 2}
