import random

import pytest

WORDS = {
    "en": "the of and to in that is was for on with they this have from when there which their would".split(),
    "fr": "le de et un que pour dans qui pas sur avec elle était être très même après où déjà leçon".split(),
    "de": "der die und das nicht ist ein mit für auf über wird straße größe könnte müssen schön wäre auch noch".split(),
}
DOCS = "doc_id long, text string, lang string, n_tokens string"


def prose(r: random.Random, lang: str, n: int) -> str:
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "", ",", "."]) + (str(r.randrange(999)) if r.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, secrets, odd scripts, and empty and long ones."""
    r = random.Random(5)
    out = [prose(r, r.choice([*WORDS]), r.randrange(20, 200)) for _ in range(60)]
    passage = prose(r, "en", 90)
    out += [prose(r, "fr", 30) + " " + passage + " " + prose(r, "de", 30) for _ in range(4)]
    out += [out[0], out[0], out[1].replace(" ", "  ", 3), out[2].replace("e", "E", 1)]
    words = out[3].split()
    words[len(words) // 2] = "changed"
    out += [" ".join(words)]
    out += [None, "", "   ", "\n\t", "x", "123 456 !!", "日本語 テキスト 一二三", "ünï\u0301 \u1e9e İstanbul \u0130", "a" * 5000, "ab" * 2500, "ha " * 3000, "é" * 900]
    out += ["password: hunter2hunter2 <|endoftext|> AKIA" + "ABCDEFGH12345678", "api_key='abcd1234efgh' " + "0123456789abcdef" * 3, "Secret= short token:abc.def-ghi_jk", "ghp_" + "a1" * 20]
    out += [prose(r, "en", 20000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "clash") for i, t in enumerate(texts)] + [(0, texts[0], "en", "clash"), (None, texts[4], None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
