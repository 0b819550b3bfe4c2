"""Small tables with everything that real ones may hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, kept string, "
          "copy int, fp string, n int, removed_lines string, sequence_id string, tags array<string>, props map<string,int>")

WORDS = {"en": "the of and to in is that for it with as was on be by this are from at which".split(),
         "de": "der die und das nicht ich ein zu mit auf für ist von dem sich auch werden bei nach über".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    parts = []
    for i in range(words):
        w = rng.choice(WORDS[lang])
        parts.append(w if rng.random() < 0.6 else w + "".join(rng.choice("aeinrst") for _ in range(3)))
    return " ".join(parts)


def odd_rows():
    rng = random.Random(7)
    long_text = prose(rng, "en", 30_000)
    base = prose(rng, "en", 120)
    near = base.rsplit(" ", 1)[0] + " ending"
    texts = [(1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, near, "en", "a"), (3, near, "en", "a"), (None, base, None, None),
             (4, None, "en", "a"), (5, "", "de", "b"), (6, " \n\t ", None, "b"), (7, long_text, "en", "c"), (8, long_text, "en", "c"),
             (9, "x", "en", None), (9, "y", "de", None), (10, "ÄÖÜ straße 日本語 😀", "de", "b"), (11, "12 34", None, "b"),
             (None, None, None, None), (12, "a\n\nb\n", "en", "a"), (13, "<|endoftext|> the", "en", "a"), (-5, "x" * 5000, "en", "a")]
    texts += [(100 + i, prose(rng, "de" if i % 3 else "en", 20 + i), "de" if i % 3 else "en", "ab"[i % 2]) for i in range(40)]
    return [(i, t, l, s, len(t) if t is not None else None, 0.5, "c", "k", 1, "f", 3, "r", "q", ["t"], {"m": 1})
            for i, t, l, s in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
