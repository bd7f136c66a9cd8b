from __future__ import annotations

import random
import re
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from entitylake.functions import markup
from entitylake.operators.classify import classify_stats, entity_decision, false_match
from entitylake.operators.entities import extract_entities, lookup_rows

BOX = """Lead
{{Infobox musical artist
| name = Mira Vale
| genre = {{hlist|[[Chamber pop]]|[[drone music]]|tape}}
| years_active = 2003–present
| label = [[Quiet Barn Records]]
| birth_place = [[Harbour Town, Northland]], near the sea<ref>letter</ref>
| birth_name = Miranda Oda Vale
}}
"""

PAGE = """}}
{{Short description|A singer who does not exist}}
{{Infobox musical artist
| name = Mira Vale
| caption = on the [[Small Stage]]
}}

'''Miranda Oda Vale''' (born 1981), called '''Mira Vale''', sings and builds [[organ (music)|organs]]. With [[Tom Reed]] she leads the trio [[Salt Lamps]].{{Cite book |last=B |title='Of Reeds' }}

== Youth ==
She grew up by the sea.
"""


def test_categories(one):
    text = "[[Category:English rock bands]] x [[category: Musical groups |key]] [[Category:]] [[Categorie:No]]"
    assert one(markup.categories(F.lit(text))) == ["English rock bands", "Musical groups"]


def test_clean_list(one):
    assert one(markup.clean_list(F.lit("{{hlist|[[Chamber pop]]|[[slow waltz]]|[[field recording]]}} "))) == [
        "Chamber pop", "slow waltz", "field recording",
    ]
    assert one(markup.clean_list(F.lit("{{hlist|<b>x</b>| }}"))) == ["x"]
    assert one(markup.clean_list(F.lit("{{hlist| | }}"))) is None
    assert one(markup.clean_list(F.lit("[[a|b]] c"))) == ["b c"]
    assert one(markup.clean_list(F.lit("{{gone}}"))) is None
    assert one(markup.clean_list(F.lit(None).cast("string"))) is None


def test_clean_value(one):
    cases = {
        "[[Harbour Town, Northland]], near": "Harbour Town, Northland, near",
        "[[A|b]] {{small|x}}<br/>  c": "b c",
        # tags go before reference bodies: the body stays
        "1990<ref name=a>see</ref>": "1990see",
        "{{flatlist|[[a]]}}": "a",
        "  ": None,
    }
    for raw, clean in cases.items():
        assert one(markup.clean_value(F.lit(raw))) == clean, raw


def test_infobox_fields(one):
    got = one(markup.infobox_fields(F.lit(BOX))).asDict()
    assert got == {
        "genre": "{{hlist",  # cut at the first bar, even inside a template
        "origin": "Harbour Town, Northland, near the sealetter",
        "years_active": "2003–present",
        "label": "Quiet Barn Records",
        "members": None,
        "birth_name": "Miranda Oda Vale",
    }
    whole = one(markup.infobox_fields(F.lit(BOX), whole_templates=True)).asDict()
    assert whole["genre"] == ["Chamber pop", "drone music", "tape"]
    assert whole["label"] == ["Quiet Barn Records"] and whole["members"] is None
    assert set(one(markup.infobox_fields(F.lit("no box"))).asDict().values()) == {None}


def test_abstract(one):
    assert one(markup.abstract(F.lit(PAGE))) == (
        "Miranda Oda Vale (born 1981), called Mira Vale, sings and builds organs. "
        "With Tom Reed she leads the trio Salt Lamps."
    )


def test_abstract_line_rules(one):
    cases = {
        "": "",
        "a\nb\n\nc": "a b",  # stops at the first blank after text
        "\n\n a  b \nc": "a b c",
        "[[Link]] opens\nnext": "next",  # a paragraph opening with a link is lost
        "#redirect\n| cell\ntext }}": "text",
        "{{t\nin\n}}\nout": "",  # the closing line lowers the depth but starts with braces
        "{{t\nin\n}} \nout": "out",
        "x\n== H ==\ny": "x",
        "'''b''' <ref>no</ref>{{efn|n}}t": "b t",
        "}}\n}}\nafter": "after",
        f"{'w' * 501}\nmore": "w" * 501,
        f"{'w' * 400}\n{'v' * 400}\nmore": "w" * 400 + " " + "v" * 400,
    }
    cases["{{t\nin\n}}\nout"] = "out"
    for text, expected in cases.items():
        assert one(markup.abstract(F.lit(text))) == expected, text


def by_position(text):
    """The abstract from the positions of its lines: their kinds, running lengths and first end."""
    lines = text.split("\n")
    depths = list(accumulate(x.count("{{") - x.count("}}") for x in lines))
    plain = [re.sub(markup.LINK, r"\2", x) for x in lines]
    for gone in (markup.EMPHASIS, markup.REFERENCE, markup.CITATION, markup.FOOTNOTE, markup.TAG, markup.TEMPLATE):
        plain = [re.sub(gone, "", x) for x in plain]
    plain = [" ".join(x.split()) for x in plain]
    outside = [i for i, d in enumerate(depths) if d <= 0]
    headings = [i for i in outside if lines[i].startswith(markup.HEADING_START)]
    body = [
        i for i in outside
        if i not in headings
        and not lines[i].startswith(markup.SKIPPED_LINE_STARTS)
        and not plain[i].startswith(markup.SKIPPED_CLEAN_STARTS)
    ]
    filled = [i for i in body if plain[i]]
    long = [i for i, n in zip(filled, accumulate(len(plain[i]) + 1 for i in filled)) if n - 1 > markup.ABSTRACT_LENGTH]
    blank = [i for i in body if not plain[i] and filled and filled[0] < i]
    last = min([len(lines), *headings, *long, *blank])
    joined = " ".join(plain[i] for i in filled if i <= last)
    return re.sub(markup.LEFTOVER_BRACES, "", joined).strip()


def test_abstract_equals_its_definition_by_positions(spark):
    rng = random.Random(5)
    pieces = ["{{a", "}}", "[[x|y]]", "[[z]]", "''", "'''b'''", "<ref>r</ref>", "<br>", "{{cite q}}", "{{t}}", "word", " ", "\n", "\n", "\n\n",
              "== h ==", "|", "#", "w" * 90, " ", "<", "]]"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", markup.abstract("t").alias("a")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == by_position(t), t


# --- types ----------------------------------------------------------------------

CASES = [
    # The nine titles whose types must come out as published.
    ("Bandwidth (signal processing)", "{{Infobox thing\n}}", ["Signal processing", "Telecommunication theory"], None, "off_topic"),
    ("Wireless broadband", "{{Infobox thing\n}}", ["Wireless networking", "Broadband"], None, "off_topic"),
    ("The Beatles", "{{Infobox musical artist\n}}", ["English rock bands", "Musical groups"], "band", None),
    ("Abandonment of an action", "Some legal text", ["Legal terminology"], None, "off_topic"),
    ("Rock band", "{{Infobox band\n}}", ["Rock bands", "Musical groups"], "band", None),
    ("Frequency band", "Some text about frequency bands", ["Radio spectrum", "Telecommunications"], None, "off_topic"),
    ("Jazz Band Name", "A jazz group", ["Jazz bands", "American jazz ensembles"], "band", None),
    ("Something with band", "No infobox", ["General topics"], None, "word_without_category"),
    ("Bob Dylan", "{{Infobox musical artist\n}}", ["American singer-songwriters", "Folk musicians"], "artist", None),
    # and beyond
    ("Plain bands", "", ["Rock bands"], None, "no_evidence"),  # a plural is not the whole word
    ("Album one", "{{ Infobox  Album\n}}", [], "artist", None),  # the infobox alone gives a type
    ("Album one", "text", [], None, "no_type"),
    ("McSong", "text", [], "artist", None),  # substring tests: mc, song
    ("Both", "", ["Music", "Singers", "Bands"], "artist", None),  # artist words precede band words
    ("Song by the band", "", [], "band", None),
]


def test_decisions(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, title string, text string, categories array<string>")
    d = entity_decision(F.col("title"), F.col("text"), F.col("categories"))
    got = [(r.d.type, r.d.reason) for r in df.orderBy("i").select(d.alias("d")).collect()]
    assert got == [c[3:] for c in CASES]
    counts = {r.detail: r.n for r in classify_stats(df).collect()}
    assert counts == {"off_topic": 4, "band": 4, "artist": 4, "word_without_category": 1, "no_evidence": 1, "no_type": 1}


@pytest.mark.parametrize(
    ("categories", "wrong"),
    [
        (["Greek gods"], True),
        (["Fictional characters", "Fictional musical groups"], False),
        (["A", "B", "C", "D", "E", "F"], True),
        (["A", "B", "C", "D", "E"], False),
        (["A", "B", "C", "D", "E", "Musicians"], False),
        (["Musicians", "Saints of X"], True),
        ([], False),
        (None, False),
    ],
)
def test_false_match(spark, categories, wrong):
    df = spark.createDataFrame([(categories,)], "categories array<string>")
    assert df.select(false_match("categories").alias("w")).first().w is wrong


def test_extraction_keeps_fields_that_the_first_rows_lack(spark):
    pages = spark.createDataFrame(
        [
            ("Bob Dylan", "Singer.\n\n[[Category:American musicians]]"),
            ("The X", BOX + "Text.\n\n[[Category:Musical groups]]"),
            ("Stone", "A stone.\n[[Category:Geology]]"),
            ("Talk:Music", "chat [[Category:Musicians]]"),
        ],
        "title string, text string",
    )
    rows = {r.title: r for r in extract_entities(pages).collect()}
    assert set(rows) == {"Bob Dylan", "The X", "Talk:Music"}
    assert rows["The X"].birth_name == "Miranda Oda Vale" and rows["Bob Dylan"].birth_name is None
    assert (rows["The X"].type, rows["The X"].id, rows["The X"].url) == ("band", "The_X", "https://en.wikipedia.org/wiki/The_X")
    assert rows["Bob Dylan"].abstract == "Singer."
    main = extract_entities(pages, main_namespace_only=True)
    assert {r.title for r in main.collect()} == {"Bob Dylan", "The X"}
    assert lookup_rows(main).columns == ["id", "title", "type", "url"]
