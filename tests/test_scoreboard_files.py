import pytest

from gradeline.sources import scoreboards as S

ROW = "{},90.0,N/A,80.0,N/A,85.0,10,9\n"


def put(folder, name, *projects):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(S.HEADER + "\n" + "".join(ROW.format(p) for p in projects))


def names(spark, folder, root=None):
    return sorted(r["project"] for r in S.local_scoreboards(spark, str(folder), str(root) if root else None).collect())


def test_all_files_of_the_newest_day(spark, tmp_path):
    put(tmp_path / "a", "evaluation_scoreboard_2026-05-01.csv", "old")
    put(tmp_path / "a", "evaluation_scoreboard_2026-05-17_task0.csv", "n0")
    put(tmp_path / "a", "evaluation_scoreboard_2026-05-17_task1.csv", "n1")
    put(tmp_path / "a", "combined.csv", "c")
    put(tmp_path / "a", "other.csv", "x")
    assert names(spark, tmp_path / "a") == ["n0", "n1"]


def test_a_newest_day_without_rows_leads_to_the_combined_file(spark, tmp_path):
    put(tmp_path / "a", "evaluation_scoreboard_2026-05-01.csv", "old")
    put(tmp_path / "a", "evaluation_scoreboard_2026-05-17.csv")
    put(tmp_path / "root", "evaluation_scoreboard_2026-04-01.csv", "r")
    assert names(spark, tmp_path / "a", tmp_path / "root") == ["r"]
    put(tmp_path / "a", "combined.csv", "c")
    assert names(spark, tmp_path / "a", tmp_path / "root") == ["c"]
    put(tmp_path / "a", "combined.csv")
    assert names(spark, tmp_path / "a", tmp_path / "root") == []


def test_the_root_has_one_file_of_its_newest_day(spark, tmp_path):
    put(tmp_path / "root", "evaluation_scoreboard_2026-04-01.csv", "r")
    put(tmp_path / "root", "evaluation_scoreboard_2026-04-01_task3.csv", "task")
    put(tmp_path / "root", "evaluation_scoreboard_undated.csv", "u")
    assert names(spark, tmp_path / "none", tmp_path / "root") == ["r"]
    put(tmp_path / "root", "evaluation_scoreboard_2026-06-01_task0.csv", "only a task")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        names(spark, tmp_path / "none", tmp_path / "root")
    with pytest.raises(FileNotFoundError):
        names(spark, tmp_path / "none")
