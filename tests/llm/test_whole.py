"""Cases in which the training-data operators once did less than the whole job."""

import re
from datetime import datetime

from quillspark.llm import extract, pii, simhash

from .conftest import KEY


def test_dedup_leaves_one_row_of_each_group(spark):
    long = " ".join(f"word{i}" for i in range(80))
    other, alone = " ".join(f"thing{i}" for i in range(80)), " ".join(f"lone{i}" for i in range(80))
    rows = [(7, long, "a"), (7, long, "a"), (7, long, "b"), (9, long, "a"), (None, long, "a"), (None, other, "a"), (None, other, "a"), (None, other, "c"), (0, alone, "a"), (3, "", "a"), (None, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = simhash.simhash_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got.collect()) == sorted([(False, 7, long), (True, 0, other), (False, 0, alone), (False, 3, "")])


def test_ranks_among_many_siblings():
    page = "<div>" + "".join(f"<p>{'word ' * (1 + k % 9 * 20)}</p>" for k in range(120)) + "</div>"
    nodes, blocks = extract.read(page)
    rows = extract.features(nodes, blocks, len(page))
    parent = max(nodes, key=lambda x: len(x.children))
    assert len(parent.children) == 120 and [rows[i - 1][-11] for i in parent.children] == [k / 120 for k in range(120)]


def test_dates_and_secrets_that_were_left(spark):
    dates = ["25/12/2023", "31/1/2020", "14/07/1789", "1/2/1492", "1066-10-14", "3.4.0042", "12/31/9999", "29.02.2400", "0001-01-01"]
    secrets = ["0123456789abcdef" * n for n in (9, 500)] + ["ABCDEF0123456789" * 9]
    values = dates + secrets
    got = pii.pii_report(spark.createDataFrame([(i, f"on {v} it was") for i, v in enumerate(values)], "doc_id int, text string"), KEY).orderBy("doc_id").collect()
    for v, r in zip(values, got):
        new = r.text.removeprefix("on ").removesuffix(" it was")
        assert r.n_pii == 1 and new != v, v
        if v in dates:
            shape = "%Y-%m-%d" if "-" in v else "%d.%m.%Y" if "." in v else "%d/%m/%Y" if int(v.split("/")[0]) > 12 else "%m/%d/%Y"
            assert datetime.strptime(new, shape) and [len(x) for x in re.split("[./-]", new)][::-1][0 if "-" not in v else 2] == 4
        else:
            assert len(new) == len(v) and re.fullmatch("[0-9A-Fa-f]+", new)
    bad = spark.createDataFrame([(1, "32/13/2020 and 0000-01-01")], "doc_id int, text string")
    assert pii.pii_report(bad, KEY).first().n_pii == 0
