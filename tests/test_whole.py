from __future__ import annotations

import random

from readloom.functions.alignment import align_pairs
from readloom.queries import QUERIES


def test_align_strings_reads_whole_documents(spark, tmp_path):
    rng = random.Random(3)
    same = "".join(rng.choice("acgt") for _ in range(64))
    texts = [same + "acgt" * 20, same + "acgt" * 20, same + "ttga" * 9, same, "ac, GT!", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bases = ["".join("ACGT"[(ord(c) - ord("a")) % 4] for c in t.lower() if c.isascii() and c.isalpha()) for t in texts]
    got = {r.ref_align.replace("-", ""): r for r in QUERIES["align_strings"](spark, str(tmp_path)).collect()}
    assert set(got) == set(bases)
    for read, r in got.items():
        assert (r.score, r.query_align, r.ref_align) == align_pairs([(bases[0], read)], 5, -4, -8, -2, 16)[0]
