"""Languages, frameworks, manifests and profiles: the application layouts every release must recognise."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import paths
from riskloom.operators import filters, manifests, metrics, ranking
from riskloom.plans import profile

NPM = lambda deps, dev=None: json.dumps({"dependencies": deps, "devDependencies": dev or {}})
APPS = {
    "react": ({"package.json": NPM({"react": "^18", "react-dom": "^18"}, {"webpack": "^5"}), "src/App.jsx": "x", "src/components/Header.jsx": "x", "webpack.config.js": "x"}, "React"),
    "next": ({"package.json": NPM({"next": "13", "react": "18"}), "pages/index.js": "x", "pages/api/users.js": "x", "next.config.js": "x"}, "Next.js"),
    "django": ({"requirements.txt": "Django==4.0.0\npsycopg2==2.9.0", "manage.py": "x", "settings.py": "x", "models.py": "x", "views.py": "x"}, "Django"),
    "flask": ({"requirements.txt": "Flask==2.0.0\nFlask-SQLAlchemy==2.5.0", "app.py": "x", "routes.py": "x", "models.py": "x"}, "Flask"),
    "spring": ({"pom.xml": "<artifactId>spring-boot-starter-web</artifactId>", "src/main/java/App.java": "x", "src/main/java/Ctl.java": "x", "src/main/resources/application.properties": "x"}, "Spring Boot"),
    "laravel": ({"composer.json": '{"require": {"laravel/framework": "^9"}}', "artisan": "x", "app/Http/Controllers/UserController.php": "x", "routes/web.php": "x", "config/app.php": "x"}, "Laravel"),
    "rails": ({"Gemfile": "gem 'rails', '~> 7.0'", "config/application.rb": "x", "app/controllers/application_controller.rb": "x", "app/models/user.rb": "x", "db/migrate/001_create_users.rb": "x"}, "Ruby on Rails"),
    "express": ({"package.json": NPM({"express": "^4", "cors": "^2"}), "server.js": "x", "routes/users.js": "x", "middleware/auth.js": "x"}, "Express"),
    "gin": ({"go.mod": "module m\nrequire github.com/gin-gonic/gin v1.9.0", "main.go": "x", "handlers/user.go": "x"}, "Gin"),
    "none": ({"README.md": "x", "LICENSE": "x", "script.js": "x"}, "None"),
}


@pytest.fixture(scope="module")
def detected(spark, files_of):
    files = files_of({name: tree for name, (tree, _) in APPS.items()})
    rows = profile.build_profile(files).collect()
    return {r.repo: r for r in rows}


@pytest.mark.parametrize("app", [a for a in APPS])
def test_primary_framework(detected, app):
    assert detected[app].primary_framework == APPS[app][1]


def test_side_categories(detected):
    assert "Webpack" in detected["react"].build_tools
    assert "PostgreSQL" in detected["django"].databases
    assert "React" in detected["next"].secondary_frameworks
    assert "SQLAlchemy" in detected["flask"].secondary_frameworks
    assert list(detected["none"].secondary_frameworks) == []


def test_indicators(spark, files_of):
    files = files_of({name: tree for name, (tree, _) in APPS.items()})
    first = {(r.repo, r.framework): r.indicator for r in manifests.detect_frameworks(files).collect()}
    assert first["react", "React"] == "package.json"
    assert first["gin", "Gin"] == "go.mod"


def test_two_frameworks(spark, files_of):
    files = files_of({"two": {"package.json": NPM({"react": "1", "express": "1"}), "client/src/App.jsx": "", "server/index.js": "", "docker-compose.yml": ""}})
    found = {r.framework for r in manifests.detect_frameworks(files).collect()}
    assert {"React", "Express"} <= found


def test_profile_rulesets(detected):
    assert {"p/javascript", "p/react", "p/owasp-top-ten", "p/xss", "p/secrets", "p/supply-chain"} <= set(detected["react"].rulesets)
    assert {"p/python", "p/django", "p/xss"} <= set(detected["django"].rulesets)
    assert {"p/java", "p/spring", "p/jwt", "p/cwe-top-25"} <= set(detected["spring"].rulesets)
    for row in detected.values():
        assert len(row.rulesets) == len(set(row.rulesets))
    assert detected["react"].profile_key == "javascript-react"
    assert detected["none"].profile_key == "javascript"


@pytest.mark.parametrize("sizes, threshold, primary, secondary", [
    ({"JavaScript": 85000, "TypeScript": 12000, "CSS": 3000}, 10, ("JavaScript", 85.0), ("TypeScript", 12.0)),
    ({"Python": 95000, "HTML": 5000}, 10, ("Python", 95.0), None),
    ({"Java": 45000, "Kotlin": 40000, "XML": 15000}, 20, ("Java", 45.0), ("Kotlin", 40.0)),
    ({"Python": 100000}, 10, ("Python", 100.0), None),
    ({"Go": 90, "C": 10}, 10, ("Go", 90.0), ("C", 10.0)),
])
def test_language_shares(spark, sizes, threshold, primary, secondary):
    stats = spark.createDataFrame([("r", k, v) for k, v in sizes.items()], "repo string, language string, bytes bigint")
    row = profile.language_profile(metrics.language_share(stats), threshold).first()
    assert (row.primary_language, round(row.primary_pct, 6)) == primary
    if secondary is None:
        assert row.secondary_language is None
    else:
        assert (row.secondary_language, round(row.secondary_pct, 6)) == secondary


def test_no_languages(spark):
    empty = spark.createDataFrame([], "repo string, language string, bytes bigint")
    assert metrics.language_share(empty).count() == 0


def test_file_lists(spark, files_of):
    files = files_of({
        "web": dict.fromkeys(["package.json", "src/components/App.jsx", "src/utils/api.js", "public/index.html", "src/styles/main.css", "webpack.config.js"], ""),
        "py": dict.fromkeys(["requirements.txt", "app.py", "models/user.py", "views/auth.py", "static/css/style.css", "templates/index.html"], ""),
        "java": dict.fromkeys(["pom.xml", "src/main/java/A.java", "src/main/java/B.java", "src/main/java/C.java", "application.properties"], "")})
    got = {r.repo: r.primary_language for r in profile.language_profile(metrics.language_share_by_files(files), 5).collect()}
    assert got == {"web": "JavaScript", "py": "Python", "java": "Java"}


def test_npm_development_entry_wins_and_fallback(spark, files_of):
    files = files_of({"a": {"package.json": NPM({"react": "1", "x": "2"}, {"react": "9"})}, "b": {"package.json": '{"dependencies": {"react": "1", "vite": '}})
    deps = {(r.repo, r.name): r.version for r in manifests.npm_deps(files).collect()}
    assert deps == {("a", "react"): "9", ("a", "x"): "2"}
    assert {(r.repo, r.pattern) for r in manifests.npm_fallback(files).collect()} == {("b", "react"), ("b", "vite")}


def test_pip_and_maven(spark, files_of):
    files = files_of({"a": {"requirements.txt": "# c\n\nDjango>=4\nflask-sqlalchemy==1\npsycopg2<=2\nredis\ncelery==5",
                            "pom.xml": "<a>spring-boot</a><a>spring-security-web</a>"}})
    pip = {(r.framework, r.category) for r in manifests.pip_deps(files).collect()}
    assert {("Django", "framework"), ("Flask", "framework"), ("SQLAlchemy", "framework"), ("PostgreSQL", "database"), ("Redis", "database"), ("Celery", "framework")} == pip
    assert {(r.framework, r.category) for r in manifests.maven_hits(files).collect()} == {("Spring Boot", "framework"), ("Spring Security", "security")}


def test_framework_tie_breaks(spark):
    hits = spark.createDataFrame([("r", "B", "framework", 2, 0), ("r", "A", "framework", 2, 0), ("r", "C", "framework", 2, 1), ("r", "D", "framework", 1, 1), ("r", "E", "framework", 1, 0)],
                                 "repo string, framework string, category string, n bigint, manifest_hits bigint")
    ranked = [r.framework for r in ranking.rank_frameworks(hits).orderBy("rank").collect()]
    assert ranked == ["C", "A", "B", "D"]


def test_overrides(spark, detected, files_of):
    files = files_of({name: tree for name, (tree, _) in APPS.items()})
    overrides = spark.createDataFrame([("react", "Go", None, " p/x ,p/secrets"), ("gin", None, "Django", None)],
                                      "repo string, force_language string, force_framework string, extra_rulesets string")
    got = {r.repo: r for r in profile.apply_overrides(profile.build_profile(files), overrides).collect()}
    assert got["react"].primary_language == "Go" and got["react"].primary_pct == 100.0
    assert list(got["react"].rulesets)[-2:] == ["p/x", "p/secrets"]
    assert got["gin"].primary_framework == "Django" and list(got["gin"].secondary_frameworks) == [] and got["gin"].confidence == 0.5
    assert got["django"].rulesets == detected["django"].rulesets


@pytest.mark.parametrize("url, want", [
    ("https://github.com/owner/repo", ("owner", "repo", True)), ("https://github.com/owner/repo.git", ("owner", "repo", True)),
    ("git@github.com:owner/repo.git", ("owner", "repo", True)), ("https://github.com/owner/repo/", ("owner", "repo", True)),
    ("https://github.com/my-org/my_repo.js", ("my-org", "my_repo.js", True)), ("not-a-url", (None, None, False)),
    ("https://gitlab.com/a/b", (None, None, False)),
])
def test_repository_urls(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(paths.parse_repo_url(F.col("u")).alias("r")).first().r
    assert (row.owner, row.name, row.valid) == want


@pytest.mark.parametrize("path, want", [
    ("src/a.py", True), ("node_modules/a.js", False), ("robin/x.py", False), ("a.png", False), ("Dockerfile", True), ("requirements.txt", False),
    ("package.json", True), ("notes", False), ("infra/main.tf", True), ("a.TXT", False), ("b.PY", True),
])
def test_analysable(spark, path, want):
    row = spark.createDataFrame([(path,)], "p string").select(filters.analysable(F.col("p")).alias("ok")).first()
    assert row.ok is want


def test_analysable_by_segment(spark):
    rows = spark.createDataFrame([("robin/x.py",), ("a/bin/x.py",), ("bin/x.py",)], "p string")
    assert [r.ok for r in rows.select(filters.analysable(F.col("p"), True).alias("ok")).collect()] == [True, False, False]
