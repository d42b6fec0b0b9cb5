"""Decontamination of short items and of scripts without spaces."""

from sigmill.llm import decontaminate

CHINESE = "水是生命之源没有水就没有地球上的万物生长"
THAI = "ภาษาไทยเขียนติดกันโดยไม่มีช่องว่าง"


def test_short_items_and_unspaced_scripts_are_found(spark):
    items = [(1, "Quartz"), (2, "seven plus nine"), (3, "who wrote the silver lamp novel"), (4, CHINESE), (5, THAI), (6, "..."), (7, None)]
    changed = CHINESE.replace("生命", "火", 1)
    docs = [
        (1, "a quartz, b"), (2, "what is SEVEN plus\nnine?"), (3, "seven plus ten nine"), (4, "so who wrote a silver lamp novel then"), (5, "who wrote one old lamp novel"),
        (6, f"前言{CHINESE}后记"), (7, f"前言，{changed}。"), (8, f"คำนำ{THAI}จบ"), (9, "水是好的没有问题"), (10, "quartzite ..."), (11, ""), (12, None),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id): (x.distance, dict(docs)[x.doc_id][x.start : x.end]) for x in decontaminate.op3(df, bench).collect()}
    assert got == {
        (1, 1): (0, "quartz"), (2, 2): (0, "SEVEN plus\nnine"), (4, 3): (1, "who wrote a silver lamp novel"),
        (6, 4): (0, CHINESE), (7, 4): (2, changed), (8, 5): (0, THAI),
    }
    assert {x.doc_id for x in decontaminate.without_leaks(df, bench).collect()} == {3, 5, 9, 10, 11, 12}
