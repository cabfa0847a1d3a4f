"""Texts that the operators have to stand: empty, odd white space, long, repeated, many alphabets."""

import random

_r = random.Random(7)
ODD = [
    None, "", " ", "  \n ", "a", "A b", "a  b", " lead", "trail ", "\n\n", "a\n\nb\tc\rd", "x\x1cy \x85z", "a b 　 c", "日本語テキスト" * 40,
    "é ñ ü ẞ ſ ǅ ŉ İstanbul ΣΑΣ", "\U0001f600 \U0001f600 mail a@b.cd", "<|endoftext|>", "a<|endoftext|>  b <|startoftext|>", "'s 'll don't I'LL", "a" * 4000,
    "ab" * 1500, "!" * 3000, "1" * 5000, "1 " * 2000, "a@" * 1000, "x@y." * 500, "+1-" * 700, "1.2.3.4.5.6.7.8", "300.1.2.3 1.2.3.256 0001.02.3.255",
    "mail me: kf.71@mail0.example.com +1 (578) 555-6437 4918187128635271 or 4918-1871 2863 5271.", "a.b@c.d%e@f.gh", "%+@-.-.", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
    "under the mit license under the mit license", "cc by by nc CC BY NC",
]
ODD += ["".join(_r.choice("ab !\n é1'sthe@.+- ()") for _ in range(250)) for _ in range(60)]
ODD += ["".join(_r.choice("aB'S!1²½éẞſµ \nŉǅ×÷¡ªɏ") for _ in range(150)) for _ in range(40)]
ODD += [ODD[28], ODD[28]]


def rows() -> list[tuple]:
    """(doc_id, text): ids from 0, then a null id and a repeated row."""
    made = list(enumerate(ODD))
    return [*made, (None, "null id text here now"), made[5]]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, "doc_id long, text string")
