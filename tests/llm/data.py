"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing extra columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, key string, node long, rank int, document string"

SYLLABLES = {"en": "the ing er tion an re ed on at st".split(), "de": "der ung ein sch ge ver lich zu en be".split(), "fr": "le eau tion que ou ier la ment é è".split()}
COMMON = {"en": "the of and to in is that", "de": "der die und von zu das mit", "fr": "le la les et est un que"}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = []
    for _ in range(n):
        if rng.random() < 0.4:
            words.append(rng.choice(COMMON[lang].split()))
        else:
            words.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 5))))
    return " ".join(words)


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(rng, lang, rng.randrange(30, 120))
        if i % 10 == 4:
            text += f' password="{rng.getrandbits(80):020x}" mail user{i}.{i}@mail.example.com on 192.168.{i}.{i + 1}'
        out.append((i, text, lang, ("hot" if i % 2 else f"s{i % 5}")))
    near = out[0][1].split()
    near[len(near) // 2] = "changed"
    out += [(10100, out[0][1], "en", "hot"), (10101, " ".join(near), "en", "s1"), (10102, None, "en", "s1"), (10103, "", None, None), (10104, "12 34 !!", "en", "s2")]
    out += [(10105, prose(rng, "de", 9000), "de", "s3"), (10106, "\x85 　 \t\n", "fr", None), (None, "the end of it", "en", "s1"), (10107, "x" * 20000, "en", "s1")]
    out += [out[5], out[5], (10108, "a b", "en", "s2"), (10109, "a b", "en", "s2")]
    return [(a, b, c, d, None if b is None else len(b), 7, 0.5, "k", 3, 1, "x") for a, b, c, d in out]


def documents(spark, n: int = 60):
    return spark.createDataFrame(rows(n), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
