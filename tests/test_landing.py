"""Landing files with good, bad and repeated rows, loaded several times."""

import gzip

import pytest

from millwright.session import fresh_path
from millwright.sources.landing import load_landing, open_landing

HEAD = "change_id,asset_id,changed_at,change_type,description\n"


@pytest.fixture
def landing(spark, tmp_path):
    store = open_landing(spark, fresh_path(spark, "landing"), ["asset_changes", "technicians"], 3)

    def put(name, text, packed=False):
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if packed else text.encode())

    return store, str(tmp_path), put


def entries(df):
    return sorted((r.tbl, r.file, r.n_loaded, r.n_rejected, r.same_as) for r in df.collect())


def changes(store):
    return sorted((r.change_id, r.asset_id, r.description) for r in store.read("asset_changes").collect())


def test_loads_take_only_new_files_and_keep_what_does_not_fit(spark, landing):
    store, folder, put = landing
    put("asset_changes_1.csv", HEAD + 'C1,P1,2024-01-01 10:00:00,PART,"two\nlines, ""quoted"""\nC2,P1,not a time,PART,x\n,P1,,PART,no key\nC3,P2,,PART,\n')
    put("asset_changes_2.csv.gz", HEAD + "C3,P2,2024-01-02 00:00:00,PART,again\nC4,P3,2024-01-02 00:00:00,PART,packed\n", packed=True)
    put("technicians.csv", "technician_id,full_name,seniority,years_experience,skills,shift_pattern,retiring_2027\n"
                           "T1,Ann,SENIOR,12,a;b,DAY,true\nT2,Bob,JUNIOR,many,a,DAY,perhaps\nT3,Cy,JUNIOR\n")
    assert entries(load_landing(store, folder)) == [
        ("asset_changes", "asset_changes_1.csv", 2, 2, None), ("asset_changes", "asset_changes_2.csv.gz", 1, 1, None),
        ("technicians", "technicians.csv", 1, 2, None)]
    assert changes(store) == [("C1", "P1", 'two\nlines, "quoted"'), ("C3", "P2", None), ("C4", "P3", "packed")]
    reasons = sorted((r.tbl, r.file, r.reasons, r.n) for r in store.read("rejected_rows").collect())
    assert reasons == [
        ("asset_changes", "asset_changes_1.csv", "changed_at is no timestamp_ntz", 1),
        ("asset_changes", "asset_changes_1.csv", "no change_id", 1),
        ("asset_changes", "asset_changes_2.csv.gz", "repeats a key", 1),
        ("technicians", "technicians.csv", "retiring_2027 is no boolean; years_experience is no bigint", 1),
        ("technicians", "technicians.csv", "wrong number of columns", 1)]
    assert [tuple(r) for r in store.read("technicians").select("technician_id", "years_experience", "retiring_2027").collect()] == [("T1", 12, True)]

    assert load_landing(store, folder).count() == 0  # nothing is new
    put("asset_changes_3.csv", HEAD + "C4,P3,2024-01-05 00:00:00,PART,corrected\nC5,P3,2024-01-05 00:00:00,PART,new\n")
    put("asset_changes_copy.csv", HEAD + "C4,P3,2024-01-05 00:00:00,PART,corrected\nC5,P3,2024-01-05 00:00:00,PART,new\n")
    assert entries(load_landing(store, folder)) == [
        ("asset_changes", "asset_changes_3.csv", 2, 0, None), ("asset_changes", "asset_changes_copy.csv", 0, 0, "asset_changes_3.csv")]
    assert changes(store)[2:] == [("C4", "P3", "corrected"), ("C5", "P3", "new")]
    put("technicians_old.csv", "technician_id,full_name,seniority,years_experience,skills,shift_pattern,retiring_2027\n")
    assert entries(load_landing(store, folder)) == [("technicians", "technicians_old.csv", 0, 0, None)]
    assert len(store.read("load_ledger").collect()) == 6


def test_a_load_that_dies_is_repeated(spark, landing, monkeypatch):
    from millwright.sources import store as module
    store, folder, put = landing
    put("asset_changes.csv", HEAD + "C1,P1,2024-01-01 10:00:00,PART,x\n")
    with monkeypatch.context() as patch:
        patch.setattr(module.Batch, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            load_landing(store, folder)
    assert changes(store) == [] and store.read("load_ledger").count() == 0
    assert entries(load_landing(store, folder)) == [("asset_changes", "asset_changes.csv", 1, 0, None)]
    assert changes(store) == [("C1", "P1", "x")]
