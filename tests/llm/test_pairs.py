"""Defects of prompt and response pairs, one by one and over a table."""

import pytest

from verdigrade.llm import pairs as p

Q = "Which goods from Torrow were labelled after a shortage of rope in May?"


def defect(answer, question=Q):
    return p.judge(question, answer)[0]


@pytest.mark.parametrize("answer", [None, "", "  \n", "​⁠", "...", "…", "-", "N/A", "null", "[no answer]", "(empty)", "{}", '""', "```\n```", "``````", "<answer></answer>", "Answer:", "Final answer: not available", "<p> </p>", "None."])
def test_empty(answer):
    assert defect(answer) == "empty"


@pytest.mark.parametrize("answer", ['<div class="answer" id="final" data-role="assistant"></div>', '<p class="answer text body main part wide">N/A</p>', "<div id='a' class=one data-a-role-of-the-main-part=x hidden>\n</div>"])
def test_empty_wrapper_with_attributes(answer):
    assert defect(answer) == "empty"


def test_words_in_angle_brackets_are_an_answer():
    assert not p.is_empty("<the answer is that nine heavy ladders were labelled>")


@pytest.mark.parametrize("answer", ["No", "7", "42 credits", "Ja.", "答え", "👍", "Nothing was labelled.", '{"a": null}', "Label: trade"])
def test_not_empty(answer):
    assert defect(answer) != "empty"


@pytest.mark.parametrize(
    "answer", [Q, Q.upper(), f"  {Q.replace(' ', '  ')}\n", f'"{Q}"', f"> {Q}", f"Question: {Q}", f"Your question was: {Q}", f"You asked: {Q}", f"{Q}\n{Q}", f"{Q} {Q} {Q}", Q[:-1] + "…", f"Answer: {Q}"]
)
def test_copy(answer):
    assert defect(answer) == "copy"


@pytest.mark.parametrize("answer", [f"{Q} The heavy ladders.", "The goods from Torrow were labelled in May.", Q[:40] + " is the question, and ladders the answer."])
def test_no_copy(answer):
    assert defect(answer) != "copy"


@pytest.mark.parametrize(
    "answer",
    [
        "I'm sorry, but I can't help with that request.", "i cannot answer this question.", "As an assistant, I would rather not go into that topic. Please ask something else.",
        "My guidelines do not let me reply to this, even for Torrow.", "No answer can be given by me for safety reasons.", "That request falls outside what I may do. Please contact a qualified expert.",
        "Torrow is a fair thing to ask about. This is not something I am able to discuss.", "It would not be appropriate for me to comment.", "Unfortunately, I must decline to respond here. Is there another topic I may help with?",
        "Es tut mir leid, dabei kann ich nicht helfen. Bitte stellen Sie eine andere Frage.", "Je suis désolé, je ne peux pas répondre à cette question.", "Lo siento, no puedo ayudar con eso.", "Por desgracia, debo negarme a contestar.",
    ],
)
def test_refusal(answer):
    assert defect(answer) == "refusal"


REASON = " and because the records of the town name people who were never asked whether they want to be named" * 6


@pytest.mark.parametrize("answer", [f"I'm sorry, but I can't help with that request{REASON}.", "I am sorry\nI cannot answer this question\nPlease ask something else", "I cannot answer the\nQuestion of what was labelled in the town of Torrow in May\nor of who had asked for it.", f"Unfortunately\nI must decline to answer{REASON}\nIs there anything else"])
def test_long_refusal(answer):
    assert defect(answer) == "refusal"


@pytest.mark.parametrize("answer", [f"I cannot see one below 7068{REASON}; the lowest line is 7068 ledgers on Monday, and the foreman sold nine of them.", "I can't say more than the ledger\nThe heavy ladders of Torrow were labelled first in May\nThe ropes came later in June"])
def test_long_text_that_answers(answer):
    assert defect(answer) is None


@pytest.mark.parametrize("n", [70, 400])
def test_endless_copy(n):
    assert defect(" ".join([Q] * n)) == "copy" and defect("\n".join([Q] * n)) == "copy"


@pytest.mark.parametrize(
    "answer",
    [
        "I can't find a lower entry, so 1768 is the smallest value in the June ledger.", "They can't, because the foreman is not able to store more than 2080 hinges.", "No, they cannot.",
        "I cannot see one below 7068; the lowest line is 7068 ledgers on Monday.", "The clerk declined to answer, and the ladders were labelled by the foreman.",
    ],
)
def test_no_refusal(answer):
    assert defect(answer) is None


@pytest.mark.parametrize(
    "answer",
    [
        "Because of an early frost, the", "It pays 236801 credits, since 43, and", "The records name (see", "- One thing\n- ", "1. One thing.\n2. Another.\n3.", '{"answer": "After a strike", "unit": ', '```json\n{"note": "Records',
        "| place | count |\n| --- | --- |\n| Torrow | ", 'It says "Heute', "There are two reasons. First, frost. Second,", "The bolts that the treasurer;", "The **heavy", "See `config", "<answer>The ladders", "[1, 2, {\"a\": 3}",
    ],
)
def test_truncated(answer):
    assert defect(answer) == "truncated"


@pytest.mark.parametrize(
    "answer",
    [
        "The heavy ladders of Torrow were labelled first.", '{\n "place": "Torrow",\n "count": 1}', '```json\n{"place": "Torrow"}\n```', "It says \"Heute geschlossen\".", "The list:\n- bells\n- saddles", "| a | b |\n| --- | --- |\n| 1 | 2 |",
        "A 5\" pipe was used.", "Smile :) and go.", "a) first\nb) second", "In 2020 (see above).", "« Fermé » is written on it.", "Use `x` and **y**.", "On which we agree on", "2) ropes",
    ],
)
def test_complete(answer):
    assert defect(answer) is None


@pytest.mark.parametrize("answer", ["Wegen des Nebels blieb das Archiv geschlossen.", "Le moulin a livré 4058 caisses le mois dernier.", "La cuenta la pagó el tesorero con 12 monedas.", "Ответ: 6554, потому что товары посчитали позже.", "町の記録の27ページに書かれています。", "Answer: La risposta è 12, perché le merci furono contate più tardi."])
def test_language(answer):
    assert defect(answer) == "language"


@pytest.mark.parametrize(
    "question,answer",
    [
        ("Translate into French: The market sold lamps.", "Le marché a vendu les lampes."), ("What is written on the sign?", 'It says "Heute geschlossen".'), ("Warum war das Archiv geschlossen?", "Wegen des Nebels."),
        ("Give the Italian version of this line: The guard found keys.", "La guardia ha trovato le chiavi."), (None, "Wegen des Nebels blieb es zu."), ("", "Wegen des Nebels blieb es zu."), (Q, "Torrow"), ("What is it?", '"Fermé le lundi"'),
    ],
)
def test_same_or_asked_language(question, answer):
    assert defect(answer, question) is None


def test_tileable():
    assert p.tileable("a b c d".split(), "x a b c y b c d".split(), 3) == 6
    assert p.tileable(["a"] * 3, ["a"] * 9, 3) == 9 and p.tileable([], ["a"], 1) == 0


def test_tiling():
    of_a, of_b = p.tiling("a b c d e f g".split(), "e f g x a b c d".split(), 3)
    assert of_a.tolist() == [0, 0, 0, 0, 1, 1, 1] and of_b.tolist() == [1, 1, 1, -1, 0, 0, 0, 0]
    of_a, of_b = p.tiling("a b c".split(), "a b c a b c".split(), 3)  # a word is in one tile at most
    assert (of_a >= 0).sum() == 3 and (of_b >= 0).sum() == 3
    for a, b in (([], ["x"]), (["x"], []), (["x"], ["y"])):
        assert (p.tiling(a, b, 1)[1] >= 0).sum() == 0


def brute_tiles(a, b, least):
    """Greedy string tiling as published: the longest unmarked matches first, all positions tried."""
    ma, mb, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and not ma[i + k] and not mb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((j, i))
        if not found:
            return covered
        for j, i in sorted(found):
            if not any(ma[i : i + best]) and not any(mb[j : j + best]):
                ma[i : i + best] = mb[j : j + best] = [True] * best
                covered += best


def test_tiling_equals_brute_force():
    import random

    draw = random.Random(3)
    for _ in range(150):
        a, b = ([draw.choice("abcde") for _ in range(draw.randint(0, 25))] for _ in range(2))
        got = (p.tiling(a, b, 3)[1] >= 0).sum()
        assert abs(got - brute_tiles(a, b, 3)) <= 4  # ties of equal length may be broken in another order
        of_a, of_b = p.tiling(a, b, 3)
        for t in range(of_a.max() + 1 if len(of_a) else 0):
            assert [a[i] for i in (of_a == t).nonzero()[0]] == [b[j] for j in (of_b == t).nonzero()[0]]


@pytest.mark.parametrize("answer", ["after a shortage of rope in May? Which goods from Torrow were labelled", f"Question: {Q} Question: {Q}", f"{Q} {Q} {Q} which goods from Torrow"])
def test_copy_in_another_order(answer):
    assert defect(answer) == "copy"


def test_same_words_in_another_order_are_an_answer():
    assert defect("B is greater than A.", "Is A greater than B?") is None


def test_partial_copy():
    half = "The goods, it was said, were labelled after a shortage of rope in May."
    assert not p.is_copy(Q, half) and p.is_copy(Q, half, share=0.5)


@pytest.mark.parametrize(
    "answer",
    [
        "Use 2**3.", "the glob **/*.py", "A List<String> holds the names.", "a<b and c>d.", "It is a <b and c> d.", "sad :( but fine.", "[0, 1)", "The interval [0, 1) is half open.", "It lies in ]0, 1[ there.", "A char '(' opens.", 'The sign "(" opens.', "<b><i>x</b></i>",
        "if (x[1) then done.", "x = a[0] * 2 ** 3.", "**Bold:** text here.", "A map<string, int> is used.", "5 < 6 and 7 > 6.", "It **is\n\nfine again.", "```python\nprint('(')\n```", "See `a**b` and `<div>`.",
        "Call it so:\n\n```c\nif (a < b) { x[0] = \"(\";\n```\n\nThen `ls **/*.c | wc -l` counts a <T> list of vector<int> and 2**8 bytes :) in [0, n).",
    ],
)
def test_code_in_an_answer_is_complete(answer):
    assert defect(answer) is None


@pytest.mark.parametrize("answer", ['{"a":{"b":["x"', "text <b>bold", "See <di", "He said “yes", "A call f(a, g(b), <b>c</b>", "One `code` and `more", "Fine.\n\nThe **last one is", "<table><tr><td>a</td></tr>", "| a | b |\n| --- | --- |\n| 1"])
def test_open_structure(answer):
    assert defect(answer) == "truncated"


@pytest.mark.parametrize(
    "answer",
    [
        "Niestety nie mogę pomóc w tej sprawie.", "Jag kan tyvärr inte hjälpa till med det.", "К сожалению, я не могу ответить на этот вопрос.", "申し訳ございませんが、お答えできません。", "Helaas kan ik daar niet bij helpen.", "Leider kann ich dabei nicht helfen.",
        "Non posso rispondere a questa domanda.", "Não posso ajudar com isso.", "抱歉，我无法回答这个问题。", "Nie mogę odpowiedzieć, ponieważ " + "zasady tego domu są bardzo surowe i " * 12 + "tak już jest.",
    ],
)
def test_refusal_in_other_languages(answer):
    assert defect(answer) == "refusal"


@pytest.mark.parametrize("answer", ["Wir konnten dem Händler nicht helfen, weil das Lager leer war.", "Nie mogę podać dnia, ale drabiny z Torrow oznaczono w maju.", "Я не могу дать точный день, но лестницы из Торроу пометили в мае."])
def test_no_refusal_in_other_languages(answer):
    assert defect(answer) != "refusal"


def test_table(spark):
    sound = [f"The {a} {n} of Torrow were counted on Monday." for a in ("red", "blue", "old", "new") for n in ("ladders", "saddles", "anchors", "bells")]
    rows = [("t", f"s{i}", Q, s) for i, s in enumerate(sound * 2)]
    rows += [("t", "cut-word", Q, "The red lad"), ("t", "cut-middle", Q, "The blue ladders of Torrow were counted"), ("t", "no-point", Q, "The blue ladders of Torrow were counted on Monday"), ("t", "e", None, None), ("u", "e", Q, None), ("t", "e", Q, "null"), ("t", None, Q, None), ("t", "long", Q, "word and " * 60_000 + "end."), ("t", "longrow", Q, "(" * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "pair_table string, pair_id string, question string, answer string, defect int")
    got = {(r.pair_table, r.pair_id): r.defect for r in p.broken_pairs(df).collect()}
    assert got == {("t", "cut-word"): "truncated", ("t", "cut-middle"): "truncated", ("t", "e"): "empty", ("u", "e"): "empty", ("t", "longrow"): "empty"}
    assert p.broken_pairs(df.limit(0)).count() == 0
