"""Documents with every odd case, and plain versions of the operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rows int, hub string, _id int, rank int"


def passage(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def texts():
    base = " ".join(f"w{i} and more" for i in range(120))
    shared = "\n".join([passage("p", 20), passage("q", 20), passage("r", 25)])
    return [
        base,
        base,
        base.replace("w7 ", "W7 ").replace("w60 and", "x60 und"),
        base.replace("w1", "v1"),
        None,
        "",
        " \t\n\x0b\x0c\r ",
        "one",
        "One",
        "a b c d",
        "a b c d e",
        "   x",
        f"Intro of one.\n{shared}\nThe end.",
        f"Another start!\n\n{shared}\nOther end?",
        f"{passage('solo', 70)}\nfirst tail",
        f"head\n{passage('solo', 70)}",
        "ha\n" * 80,
        "Ünïcödé 漢字 😀 text. Second one! Third? " * 5,
        "x" * 70_000,
        "lorem ipsum dolor " * 30_000,
        "a  b   c ▁d e▁▁f ",
        "<s> </s> <unk> \x00",
    ]


def rows(repeats=True):
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "a"][i % 4], None if i % 5 == 0 else len(t or ""), "s", i, None, 1, 2) for i, t in enumerate(texts())]
    if repeats:
        out += [out[12], out[4], out[7], (None, "without id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


def docs(spark, repeats=True):
    return spark.createDataFrame(rows(repeats), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tables(spark, folder):
    """A folder of tables as the queries read them."""
    docs(spark, False).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 4 > 0, i % 3 == 0) for i in range(20)], "doc_id long, quality boolean, toxic boolean").selectExpr(
        "doc_id", "cast(quality as int) quality", "cast(toxic as int) toxic"
    ).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def cut_lines(documents, least=50):
    """Texts of ``(doc_id, text)`` without later copies of passages, by listing all runs of lines."""
    seen, kept = {}, {}
    lines = {}
    for doc, text in sorted(documents):
        if text is None:
            continue
        lines[doc] = [(i, x) for i, x in enumerate(text.split("\n")) if WORD.search(x)]
        counts = [len(WORD.findall(x)) for _, x in lines[doc]]
        for a in range(len(counts)):
            for b in range(a, len(counts)):
                if sum(counts[a : b + 1]) >= least:
                    seen.setdefault(tuple(x for _, x in lines[doc][a : b + 1]), []).append((doc, a, b))
                if b - a > 100:
                    break
    gone = {}
    for places in seen.values():
        for doc, a, b in sorted(places)[1:]:
            gone.setdefault(doc, set()).update(i for i, _ in lines[doc][a : b + 1])
    for doc, text in documents:
        kept[doc] = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ()))
    return kept
