from symloom.sources.packages import package_of, packages


def test_packages_by_the_nearest_manifest(spark):
    files = [
        ("Cargo.toml", '[workspace]\nmembers = ["core", "tools/*"]\n'), ("core/Cargo.toml", '[package]\nname = "grain-core"\n'), ("web/package.json", '{"name": "@grain/web", "workspaces": {"packages": ["ui"]}}'), ("svc/go.mod", "module example.org/grain/svc\n\ngo 1.22\n"),
        ("py/pyproject.toml", '[project]\nname = "grain"\n'), ("old/setup.py", "from setuptools import setup\nsetup(name='grain-old')\n"), ("bad/package.json", "{"), ("lost/go.mod", None), ("core/src/lib.rs", "fn main() {}"),
    ]
    known = packages(spark.createDataFrame([(*f, 1) for f in files], "path string, content string, folder int"))
    got = {r["folder"]: (r["ecosystem"], r["package"], r["members"]) for r in known.collect()}
    assert got == {"": ("cargo", None, ["core", "tools/*"]), "core": ("cargo", "grain-core", []), "web": ("npm", "@grain/web", ["ui"]), "svc": ("go", "example.org/grain/svc", []), "py": ("python", "grain", []), "old": ("python", "grain-old", []), "bad": ("npm", None, [])}
    paths = spark.createDataFrame([("core/src/lib.rs",), ("core/src/lib.rs",), ("svc/a/b.go",), ("top.rs",), (None,), ("py/x.py",)], "path string")
    assert {tuple(r) for r in package_of(paths, known).collect()} == {("core/src/lib.rs", "cargo", "grain-core", "src/lib.rs"), ("svc/a/b.go", "go", "example.org/grain/svc", "a/b.go"), ("py/x.py", "python", "grain", "x.py")}
    assert packages(spark.createDataFrame([], "path string, content string")).count() == 0
