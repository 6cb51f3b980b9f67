import subprocess

import pytest

from tessera.sources import commits, git

BIG = "\n".join(f"line {i} of the file" for i in range(40))


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    clock = [1_700_000_000]

    def run(*args):
        clock[0] += 60
        env = {"GIT_AUTHOR_DATE": f"{clock[0]} +0000", "GIT_COMMITTER_DATE": f"{clock[0]} +0000", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)}
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, env=env)

    def commit(**files):
        for name, text in files.items():
            path = root / name.replace("__", "/").replace("_", ".")
            path.parent.mkdir(exist_ok=True)
            if text is None:
                path.unlink()
            else:
                path.write_text(text)
        run("add", "-A")
        run("commit", "-qm", "x", "--allow-empty")

    run("init", "-q")
    commit(a_cs=BIG, other_sql="SELECT 1", **{"with space_txt": "x"})
    commit(a_cs=BIG + "\nneedle")
    run("mv", "a.cs", "b.cs")
    run("commit", "-qm", "rename")
    commit(b_cs=BIG + "\nneedle needle")
    commit(a_cs="something else\n" * 30)  # a name that is taken again
    (root / "src").mkdir()
    run("mv", "b.cs", "src/c.cs")
    commit(src__c_cs=BIG + "\nneedle needle\nmore")  # renamed and edited
    commit(src__c_cs=BIG + "\nmore", other_sql="SELECT 2")
    commit(other_sql=None)
    commit(other_sql="SELECT 3 needle")
    # two files that swap their names
    run("mv", "a.cs", "t.cs")
    run("mv", "src/c.cs", "a.cs")
    run("mv", "t.cs", "src/c.cs")
    run("commit", "-qm", "swap")
    commit(a_cs=BIG + "\nmore\nand more needle")
    # a branch that is merged
    run("checkout", "-qb", "side")
    commit(side_cs="class Side { } needle")
    run("checkout", "-q", "-")
    commit(other_sql="SELECT 4")
    run("merge", "-q", "--no-ff", "-m", "merge", "side")
    return str(root)


def git_log(root, path, *more):
    return subprocess.run(["git", "-C", root, "log", "--follow", "--format=%H", *more, "--", path], capture_output=True, text=True, check=True).stdout.split()


PATHS = ["a.cs", "src/c.cs", "other.sql", "side.cs", "with space.txt"]


def test_follow(spark, repo):
    got = commits.followed(commits.changes(spark, repo)).orderBy("back").collect()
    for path in PATHS:
        assert [r.hash for r in got if r.file == path] == git_log(repo, path), path


def test_pickaxe_and_first_appearance(spark, repo):
    history = commits.followed(commits.changes(spark, repo))
    blobs = commits.texts(history.selectExpr("explode(array(old_blob, blob)) as blob").distinct(), repo)
    asked = [(f"{p} {w}", p, w) for p in PATHS for w in ("needle", "more", "SELECT", "absent", "")]
    needles = spark.createDataFrame(asked, "fingerprint string, file string, needle string")
    found = commits.pickaxe(history, needles, blobs)
    rows = found.orderBy("back").collect()
    for name, path, word in asked:
        if word:
            assert [r.hash for r in rows if r.fingerprint == name] == git_log(repo, path, f"-S{word}"), name
    first = {r.fingerprint for r in commits.introduced(found).collect()}
    assert first == {r.fingerprint for r in rows} and "a.cs " not in first


def test_commits_are_dealt_out(spark, repo, monkeypatch):
    monkeypatch.setattr(commits, "TASK_COMMITS", 3)
    reader = commits.Reader(repo, "HEAD", None)
    tasks = reader.partitions()
    n = int(subprocess.run(["git", "-C", repo, "rev-list", "--count", "HEAD"], capture_output=True, text=True).stdout)
    assert [len(t.hashes) for t in tasks] == [3] * (n // 3) + [n % 3] * (n % 3 > 0)
    rows = [r for t in tasks for r in reader.read(t)]
    assert {(r[3], r[4], r[5]) for r in rows if r[3] == "R"} >= {("R", "a.cs", "b.cs"), ("R", "b.cs", "src/c.cs")}


def test_no_repository(spark, tmp_path):
    assert commits.changes(spark, str(tmp_path)).count() == 0
    assert commits.followed(commits.changes(spark, str(tmp_path))).count() == 0
    assert git.repository_root("/") is None
