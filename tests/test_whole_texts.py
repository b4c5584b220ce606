"""What stands after a document's first 200 characters is found too; values worked out by hand."""

import hashlib

import pytest

from cairn.plans import texts
from cairn.plans.catalog import QUERIES


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest(), len(x)


FILL = "zz " * 200
LATE = FILL + "on 2023-05-06 see lib/core/io.py every friday password=%s at https://%s@x/ TypeError"
DOCS = [(7, LATE % ("hunter2hunter2", "bob:pw12345")), (12, FILL + "[Date: 2024-03-09] 5 books"), (8, None)]
WANT = {
    "importance_and_polarity": {7: (0.6, 1), 12: (0.3, 1), 8: (0.2, -1)},
    "extract_dates": {7: ("2023-05-06",), 12: ("2024-02-03,2024-03-09,2024-3-9",), 8: ("",)},
    "occurrence_and_recurrence": {7: (None, "1,5"), 12: ("2024-03-09", None), 8: (None, None)},
    "extract_entities": {7: ("entity:TypeError,error:TypeError,file:lib/core/io.py",), 12: ("quantity:5 books",), 8: ("",)},
    "mask_secrets": {
        7: sha(texts.TEMPLATES[7] + " " + LATE % ("***MASKED***", "***MASKED***:***MASKED***")), 12: sha(texts.TEMPLATES[0] + " " + DOCS[1][1]), 8: sha(texts.TEMPLATES[8] + " "),
    },
}


@pytest.mark.parametrize("name", WANT)
def test_whole(spark, tmp_path, name):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0]: tuple(r[1:]) for r in QUERIES[name](spark, str(tmp_path)).collect()} == WANT[name]
