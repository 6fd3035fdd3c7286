"""A small table of awkward documents, and the columns that the operators must not trip over."""

#: Names that operators use for columns of their own.
INTERNAL = ("_of", "_bare", "_id", "_hash", "__of", "__id", "__hash", "_null", "_row", "_doc", "sub", "lo", "node", "text_hash", "class", "id")

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _text string, kept boolean, shard int, block int, rank int, "
          "component_id long, spans string, _next string, part int, payload binary, " + ", ".join(f"{n} string" for n in INTERNAL))


def rows():
    prose = " ".join(f"word{i * i % 97} and{i % 13}" for i in range(120))
    texts = [
        None, "", "   \n\t ", "one", "four words are here", "a b c d e", "A B C D E",
        prose, prose, prose + " tail", prose.replace("word4 ", "other "),
        "same line of text\nsame line of text\n\nsame line of text\r\n other",
        "mail a.b@mail1.example.com and x@y.org_z@w.de 10.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 00001.2.3.0255",
        "card 4111 1111 1111 1111 not 4111 1111 1111 1112, 4111-1111-1111-1111 5 4111111111111111",
        "phone +1 (509) 555-6973 and +44 20 7946 0958 12, +1 2 3", "name is Maria Lopez, call (212) 555-0187, ssn 123-45-6789 iban DE89 3700 0000 0000 4430 13 00",
        "ünïcödé 😀 " * 30 + "é@x.de", "x" * 30000, ("lorem ipsum " * 4000) + "end", "1." * 500 + " " + "9" * 5000, "@" * 300 + "a@b" + ".c" * 300,
        "tab\x0bvertical\x0cfeed  nbsp  em \x1cfs", "﻿bom text it's we'll I'd  double   spaces 12345 ²³ ½",
    ]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 7 - 3, t, "en" if i % 2 else None, None if i % 5 == 0 else "src0", None, "x", True, 1, 2, 3, 4, "y", "z", 5, b"6", *INTERNAL))
    out += [out[7], out[7], (None, prose, None, None, None, *out[0][5:]), (None, None, None, None, None, *out[0][5:]), (18, "other text with the id of another row", *out[0][2:])]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
