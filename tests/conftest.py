import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)

ENTRY = (
    "entry_id long, source_id int, source_line long, headword string, headword_norm string, ipa string, variant string, "
    "senses array<struct<pos:string,glosses:array<string>,examples:array<struct<en:string,vi:string,gloss_index:int>>>>, "
    "idioms array<struct<phrase:string,glosses:array<string>,examples:array<struct<en:string,vi:string,gloss_index:int>>>>, "
    "cross_refs array<string>"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexiloom.session import local_session, share_package

    s = local_session(4, shuffle_partitions=4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    share_package(s)
    return s


@pytest.fixture(scope="session")
def entry_rows():
    """Builds entry rows: (headword, senses, idioms) with senses as (pos, glosses)."""

    def make(*rows, source_id=0):
        out = []
        for i, (head, senses, *rest) in enumerate(rows, 1):
            s = None if senses is None else [(p, None if g is None else list(g), []) for p, g in senses]
            idioms = [(p, list(g), []) for p, g in (rest[0] if rest else [])]
            out.append((i, source_id, i, head, (head or "").strip().lower(), None, None, s, idioms, []))
        return out

    return make


@pytest.fixture(scope="session")
def entries_of(spark, entry_rows):
    return lambda *rows, **kw: spark.createDataFrame(entry_rows(*rows, **kw), ENTRY)


@pytest.fixture(scope="session")
def entry_schema():
    return ENTRY
