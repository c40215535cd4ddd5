import base64
import os
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from pilegrain.llm import encode, personal
from pilegrain.llm.personal import MAIL, Tagger, learn, numbers, redacted, spans

pytestmark = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def known():
    with open(encode.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_the_library(known):
    own, (ranks, library) = encode.encoder(encode.VOCABULARY), known
    r = random.Random(5)
    texts = ["", " ", "a", "It's <|endoftext|> here", "-" * 4000, " " * 3000 + "x", "中文" * 500, "🙂👨‍👩‍👧", "naïve\n\n\tcafé", "abcXYZ" * 900]
    texts += ["".join(r.choice("abé中 '-ll\n\t९🙂 1") for _ in range(r.randrange(400))) for _ in range(200)]
    for t in texts:
        assert own(t) == library.encode_ordinary(t)
    for t in texts[-60:]:
        w = t.replace(" ", "").encode()
        if w and w not in ranks:
            assert encode._merge_long(w, ranks) == encode.merge_word(w, ranks) or len(w) > encode.LONG_WORD


def test_columns_round_trip(spark, known):
    rows = spark.createDataFrame([(1, "hello  world"), (2, None), (3, "")], "id long, text string")
    got = {r["id"]: (r["ids"], r["n"]) for r in rows.select("id", encode.token_ids(F.col("text")).alias("ids"), encode.token_count(F.col("text")).alias("n")).collect()}
    assert known[1].decode(got[1][0]) == "hello  world" and got[1][1] == len(got[1][0])
    assert got[2] == ([], 0) and got[3] == ([], 0)


NAMES = [(f"{g}{e}", f"{f}{t}") for g in ("Mar", "Tol", "Vesh", "Jun") for e in ("en", "ira", "ock") for f in ("Hollin", "Vesper", "Tarn") for t in ("by", "wick", "gard")]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    out, truth = [], []
    for i in range(600):
        g, f = r.choice(NAMES)
        name, ssn, roll = f"{g} {f}", f"9{r.randrange(10, 99)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}", f"{r.randrange(100, 899)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}"
        tel, mail = f"+1 {r.randrange(200, 999)} 555 01{r.randrange(10, 99)}", f"{g.lower()}.{f.lower()}@mail.example"
        street = f"{r.randrange(1, 240)} {r.choice(['Ferry', 'Old Kiln'])} {r.choice(['Lane', 'Road', 'St.'])}"
        form = [
            (f"Mrs. {name} lived here.", [(name, "name")]),
            (f"Photo by {name}. The print is dark.", [(name, "name")]),
            (f"{name} signed the back.", [(name, "name")]),
            (f"thats {name.lower()} i think", [(name.lower(), "name")]),
            (f"The card reads SSN {ssn}, blurred badly. Film roll {roll} is complete.", [(ssn, "id_number")]),
            (f"The card reads {ssn}, blurred badly. Film roll {roll} is complete.", [(ssn, "id_number")]),
            (f"Call {tel} now. Film roll {roll} is complete.", [(tel, "phone")]),
            (f"Call {tel[3:].replace(' ', '-')} now.", [(tel[3:].replace(" ", "-"), "phone")]),
            (f"Write to {mail} please; see lake@2x.png.", [(mail, "email")]),
            (f"Write to {mail.replace('@', ' [at] ')} please.", [(mail.replace("@", " [at] "), "email")]),
            (f"Moved to {street}, Marlsea 00123 after the move 🙂.", [(f"{street}, Marlsea 00123", "address")]),
            ("The Blue Door album by the lake shows 4 faces.", []),
        ][i % 12]
        text = ("é🙂 " if i % 5 == 0 else "") + form[0]
        out.append((i, text))
        truth += [(i, text.index(v), text.index(v) + len(v), k) for v, k in form[1]]
    return out, truth


def test_spans_of_a_small_corpus(spark, texts):
    rows, truth = texts
    df = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "  "), (1003, "x" * 200_000)], "doc_id long, text string")
    got = {tuple(r) for r in spans(df, "doc_id", "text").collect()}
    right = len(got & set(truth))
    assert right / len(truth) > 0.97 and right / len(got) > 0.97
    assert not any(d >= 1000 for d, *_ in got)


def test_redaction_keeps_the_rest(spark, texts):
    rows, _ = texts
    df = spark.createDataFrame([*rows, (1000, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in redacted(df, "doc_id", "text").collect()}
    assert got[1000] is None and got[11] == rows[11][1]
    assert got[0] == "é🙂 Mrs. [NAME] lived here."


def test_rare_names_do_not_depend_on_the_size_of_the_corpus(spark, texts, monkeypatch):
    from pilegrain.llm import personal

    for name in ("MOST_WORDS", "MOST_PATTERNS"):  # bounds that floors once grew with
        monkeypatch.setattr(personal, name, 100, raising=False)
    rows = [*texts[0], (2000, "Photo by Quill Zebrat. The print is dark."), (2001, "Photo by Quill Zebrat. The print is dark.")]
    tagger = Tagger(learn(spark.createDataFrame(rows, "doc_id long, text string"), "text"))
    for text, name in (("thats quill zebrat i think", "quill zebrat"), ("Then Dr. Ondrel Vixby came.", "Ondrel Vixby"), ("Photo by Ondrel Vixby. The print is dark.", "Ondrel Vixby")):
        assert (text.index(name), text.index(name) + len(name), "name") in tagger.spans(text)


def test_nothing_is_learnt_from_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans(empty, "doc_id", "text").collect() == []
    learnt = learn(empty, "text")
    assert Tagger(learnt).spans("Write to a.b@c.example or ring me") == [(9, 22, "email")]


def test_forms():
    assert MAIL.search("原本はa_b@x.exampleへ").group() == "a_b@x.example"
    assert [s for *_, s, _, _ in numbers("Film roll 650-42-2205")] == ["i 999-99-9999"]
    assert [(i, j) for i, j, *_ in numbers("電話は050-0000-0143。")] == [(3, 16)]


PLACES = ["We lived at {} for years", "please write to {} soon", "Vive en {} con su madre", "she moved to {} last May", "Let us meet at {} after lunch"]
WITHHELD = ["{} Elm Parkway", "{} Oak Parkway", "{} Birch Parkway", "{} Sunset Trail", "{} Hilltop Trail", "{} Ridge Trail", "Via Roma {}, 20121 Milano", "Via Dante {}, 20121 Milano", "Via Garibaldi {}", "Kerkstraat {}, 1017 GA Amsterdam", "Dorpsstraat {}, 1017 GA Amsterdam", "Molenstraat {}", "Rua Augusta {}", "Rua do Carmo {}", "Rua Direita {}", "ul. Marszalkowska {}", "ul. Długa {}", "ul. Polna {}"]


def test_street_kinds_that_no_seed_holds_are_learnt(spark):
    """Parkway, Trail, Via, -straat, Rua and ul. are learnt from what stands around addresses of known kinds; recall and precision on them are asserted."""
    r = random.Random(1)
    known = lambda: r.choice([f"{r.randint(1, 200)} {r.choice(['Mill', 'Ferry'])} {r.choice(['Street', 'Road', 'Lane'])}", f"Calle del Olmo {r.randint(1, 99)}", f"Lerchenstraße {r.randint(1, 99)}"])
    rows, want = [r.choice(PLACES).format(known()) for _ in range(300)], []
    for _ in range(180):
        address = r.choice(WITHHELD).format(r.randint(1, 200))
        rows.append(r.choice(PLACES).format(address))
        want.append((rows[-1], address))
    noise = ["The scan of Roll Film 12 shows", "Box Number 14, shelf 3", "Canon Eos 550 took it", "Chapter Ten 12 is short", "Frame Larkspur 120 is blurred"]
    learnt = personal.learn(spark.createDataFrame([(x,) for x in rows + noise * 20], "text string"), "text")
    tagger = personal.Tagger(learnt)
    found = sum((t.index(a), t.index(a) + len(a), "address") in tagger.spans(t) for t, a in want)
    assert found >= 0.98 * len(want)
    assert not any(k == "address" for x in noise for _, _, k in tagger.spans(x))
    for a in ("Via Roma 12, 20121 Milano", "Kerkstraat 12, 1017 GA Amsterdam", "Rua Augusta 1500", "12 Elm Parkway", "44 Sunset Trail", "ul. Marszalkowska 10", "1600 Pennsylvania Avenue NW"):
        assert (0, len(a), "address") in tagger.spans(a), a
    assert personal.learnt_address({}) is None and personal.ways(spark.createDataFrame([], personal._PAIRS + ", n long").where("kind = 'way'")) == {}


def test_brackets_alone_make_a_mail_address():
    empty = dict.fromkeys(("given", "family", "common", "name", "host", "street", "town", "way", "shape phone", "pattern phone", "shape id_number", "pattern id_number"), {})
    tagger = personal.Tagger(empty)
    text = "write to jane [at] rarehost [dot] org. or ann at rarehost dot org, see pic (at) two.png"
    assert [text[i:j] for i, j, k in tagger.spans(text) if k == "email"] == ["jane [at] rarehost [dot] org"]
