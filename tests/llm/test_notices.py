"""License notices with words put in, left out or exchanged, and words of licenses that are no notice."""

import pytest

from ledgerlens.llm import license_scan

NOTICE = license_scan.NOTICES[0][0].split()


def changed(at=(), extra=(), gone=()):
    out = []
    for i, w in enumerate(NOTICE):
        out += ["put", "in", "here"][: extra.count(i)]
        if i not in gone:
            out.append("other" if i in at else w)
    return " ".join(out)


@pytest.mark.parametrize(("text", "label"), [
    (changed(), "mit"), (changed(at=(4, 12)), "mit"), (changed(extra=(9, 9, 9)), "mit"), (changed(gone=(7,), at=(15,)), "mit"), (changed().upper().replace(" ", ", "), "mit"),
    (" ".join(reversed(NOTICE)), ""), (" ".join(NOTICE[:10]), ""), (changed(at=tuple(range(0, 22, 3))), ""), ("of the and of the and to the of any and or in the", ""),
])
def test_notices(spark, text, label):
    got = license_scan.license_scan(spark.createDataFrame([(1, f"some words before {text} and after")], "doc_id long, text string")).collect()
    assert [r.labels for r in got] == [label] and [r.base_labels for r in got] == [""]
