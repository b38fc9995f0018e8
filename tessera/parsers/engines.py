"""Which database engines a project uses, from its manifests and configuration.

Only names of images, packages, schemes and drivers are told, never hosts,
users or passwords, and real ``.env`` files are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.model import Hint

# What names mean, the first pattern that is found decides.
IMAGES = (
    (None, r"adminer|pgadmin|phpmyadmin|mongo-express|redis-?commander|redisinsight|dpage|cloudbeaver"),
    ("postgresql", r"timescaledb|postgis|supabase.*postgres|postgres.*supabase"),
    ("cockroachdb", r"cockroach"),
    ("postgresql", r"(?:^|/)postgres(?:ql)?$"),
    ("sqlserver", r"mssql|sqlserver"),
    ("cosmosdb", r"cosmos"),
    ("oracle", r"oracle|database/free|database/express"),
    ("cassandra", r"scylla|(?:^|/)cassandra$"),
    ("dynamodb", r"dynamodb"),
    ("mariadb", r"(?:^|/)mariadb$"),
    ("mysql", r"(?:^|/)mysql(?:-server)?$"),
    ("neo4j", r"(?:^|/)neo4j$"),
    ("elasticsearch", r"opensearch[^/]*$|(?:^|/)elasticsearch"),
    ("clickhouse", r"clickhouse"),
    ("redis", r"valkey|(?:^|/)redis$"),
    ("mongodb", r"(?:^|/)mongo(?:db)?$"),
    ("duckdb", r"duckdb"),
)
DEPENDENCIES = (
    ("postgresql", r"^(?:pg|postgres|postgresql|psycopg|psycopg2|psycopg2-binary|asyncpg|tokio-postgres|postgrex|@neondatabase/serverless|@vercel/postgres|org\.postgresql)$|^npgsql|jackc/pgx|lib/pq$"),
    ("cockroachdb", r"cockroach"),
    ("mysql", r"^(?:mysql|mysql2|mysqlclient|pymysql|myxql|mysql\.data)$|^mysql-connector|go-sql-driver/mysql|pomelo.*mysql"),
    ("mariadb", r"^mariadb$|mariadb-connector|org\.mariadb"),
    ("sqlite", r"^(?:sqlite3|better-sqlite3|rusqlite|ecto_sqlite3|sqlite-jdbc|@libsql/client|modernc\.org/sqlite|microsoft\.data\.sqlite)$|go-sqlite3|\.entityframeworkcore\.sqlite$"),
    ("sqlserver", r"^(?:mssql|tedious|pymssql|mssql-jdbc|microsoft\.data\.sqlclient)$|go-mssqldb|\.entityframeworkcore\.sqlserver$"),
    ("oracle", r"^(?:oracledb|cx_oracle)$|godror|^ojdbc|^oracle\.manageddataaccess"),
    ("mongodb", r"^(?:mongodb|mongoose|pymongo|motor|mongoengine|mongoid|org\.mongodb|mongodb\.driver)$|mongo-driver|mongodb\.org"),
    ("redis", r"^(?:redis|ioredis|go-redis|jedis|lettuce|redix|stackexchange\.redis)$|go-redis/redis|redis/go-redis"),
    ("cassandra", r"^cassandra-driver$|gocql|datastax"),
    ("dynamodb", r"^(?:dynamoose|@aws-sdk/client-dynamodb)$|aws-sdk-go.*dynamodb|dynamodb.*aws-sdk-go"),
    ("firestore", r"^(?:@google-cloud/firestore|google-cloud-firestore)$"),
    ("cosmosdb", r"^(?:@azure/cosmos|azure-cosmos|microsoft\.azure\.cosmos)$"),
    ("neo4j", r"neo4j"),
    ("elasticsearch", r"elasticsearch"),
    ("clickhouse", r"clickhouse"),
    ("duckdb", r"(?:^|/)duckdb$"),
    ("snowflake", r"snowflake"),
    ("bigquery", r"bigquery"),
    ("h2", r"^com\.h2database$|(?:^|/)h2$"),
)
SCHEMES = (
    ("postgresql", r"jdbc:postgresql:"),
    ("postgresql", r"postgres(?:ql)?://"),
    ("cockroachdb", r"cockroachdb://"),
    ("mysql", r"jdbc:mysql:"),
    ("mysql", r"mysql://"),
    ("mariadb", r"jdbc:mariadb:"),
    ("mariadb", r"mariadb://"),
    ("sqlserver", r"jdbc:sqlserver:"),
    ("sqlserver", r"sqlserver://"),
    ("mongodb", r"mongodb(?:\+srv)?://"),
    ("redis", r"rediss?://"),
    ("clickhouse", r"clickhouse(?:\+\w+)?://"),
    ("h2", r"jdbc:h2:"),
    ("oracle", r"jdbc:oracle:"),
    ("sqlite", r"sqlite:"),
)
ADAPTERS = {
    "postgresql": "postgresql", "postgres": "postgresql", "postgis": "postgresql", "cockroachdb": "cockroachdb", "mysql": "mysql",
    "mysql2": "mysql", "trilogy": "mysql", "mariadb": "mariadb", "sqlite3": "sqlite", "sqlite": "sqlite", "sqlserver": "sqlserver",
    "sqlsrv": "sqlserver", "oracle_enhanced": "oracle", "oracle": "oracle",
}
PHP_DRIVERS = {"mysql": "mysql", "mariadb": "mariadb", "pgsql": "postgresql", "sqlite": "sqlite", "sqlsrv": "sqlserver"}
DJANGO = {"postgresql": "postgresql", "postgresql_psycopg2": "postgresql", "postgis": "postgresql", "mysql": "mysql", "sqlite3": "sqlite", "oracle": "oracle"}
OTHER_DJANGO = (("cockroachdb", r"django_cockroachdb", "django_cockroachdb"), ("mongodb", r"\bdjongo\b", "djongo"), ("sqlserver", r"sql_server\.pyodbc|mssql_backend|['\"]mssql['\"]", "mssql"))

Found = Iterator[tuple[str | None, str]]


def _first(rules: tuple, name: str) -> str | None:
    return next((engine for engine, pattern in rules if re.search(pattern, name)), None)


def image_engine(image: str) -> str | None:
    bare = re.sub(r"@.*$", "", image.strip().strip("\"'"))
    return _first(IMAGES, re.sub(r":[^/]*$", "", bare).lower()) if bare else None


def dependency_engine(name: str) -> str | None:
    return _first(DEPENDENCIES, re.sub(r"/v\d+$", "", name.strip().lower())) if name.strip() else None


def _named(pattern: str, line: str) -> Found:
    for m in re.finditer(pattern, line):
        name = m[1].strip()
        yield dependency_engine(name), f'dependency "{name}"'


def _compose(line: str) -> Found:
    if m := re.match(r"\s*image:\s*(.+?)\s*(?:#.*)?$", line):
        image = re.sub(r"\$\{[A-Za-z_]\w*:?-([^}]*)\}", r"\1", m[1].strip("\"'"))
        image = re.sub(r"\$\{[^}]*\}|\$[A-Za-z_]\w*", "", image).strip()
        yield image_engine(image), f'docker compose image "{image}"'


def _maven(line: str) -> Found:
    yield from _named(r"<(?:groupId|artifactId)>([^<]+)</", line)
    for group, artifact in re.findall(r"[\"']([\w.-]+):([\w.-]+)(?::[\w.${}-]*)?[\"']", line):
        yield dependency_engine(group) or dependency_engine(artifact), f'dependency "{group}:{artifact}"'


def _requirements(line: str) -> Found:
    if not re.match(r"\s*[#-]", line):
        yield from _named(r"^\s*([A-Za-z0-9_][A-Za-z0-9_.-]*)", line)


def _urls(line: str) -> Found:
    for engine, pattern in SCHEMES:
        if m := re.search(pattern, line, re.I):
            key = re.match(r"\s*[\"']?([\w.-]{1,60})[\"']?\s*[:=]", line)
            scheme = m[0].lower()
            yield engine, f"{key[1]} uses {scheme}" if key and not scheme.startswith(key[1].lower()) else f"connection URL uses {scheme}"
            return


def _rails(line: str) -> Found:
    if m := re.match(r"(?i)\s*adapter:\s*[\"']?([a-z0-9_]+)", line):
        yield ADAPTERS.get(m[1].lower()), f'database.yml adapter "{m[1]}"'


def _php(line: str) -> Found:
    for name in re.findall(r"(?i)['\"]driver['\"]\s*=>\s*['\"]([a-z]+)['\"]", line):
        yield PHP_DRIVERS.get(name.lower()), f'database.php driver "{name}"'
    for name in re.findall(r"(?i)['\"]default['\"]\s*=>\s*env\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]([a-z]+)['\"]", line):
        yield PHP_DRIVERS.get(name.lower()), f'database.php default "{name}"'


def _laravel(line: str) -> Found:
    if m := re.match(r"(?i)\s*DB_CONNECTION\s*=\s*[\"']?([a-z]+)", line):
        yield PHP_DRIVERS.get(m[1].lower()), f"DB_CONNECTION={m[1]}"


def _django(line: str) -> Found:
    for name in re.findall(r"django\.db\.backends\.(\w+)", line):
        yield DJANGO.get(name.lower()), f'Django ENGINE "django.db.backends.{name}"'
    for engine, pattern, name in OTHER_DJANGO:
        if re.search(pattern, line):
            yield engine, f'Django ENGINE "{name}"'


# Tables of TOML manifests that name dependencies.
DEPENDENCY_TABLES = ("dependencies", "dev-packages", "packages")


class _Toml:
    """Keys of dependency sections; the section in force is carried from line to line."""

    def __init__(self, sections: str):
        self.sections, self.inside = sections, False

    def __call__(self, line: str) -> Found:
        line = line.strip()
        if line.startswith("["):
            section = line.lstrip("[").partition("]")[0].strip()
            self.inside = bool(re.search(self.sections, section))
            # A dependency may have a section of its own: [dependencies.name].
            table, _, name = section.rpartition(".")
            if table.rpartition(".")[2] in DEPENDENCY_TABLES:
                yield from _named(r"^([\w.-]+)$", name)
        elif self.inside:
            key = line.partition("=")[0].strip().strip("\"'") if "=" in line else ""
            if key.lower() != "python":
                yield from _named(r"^([\w.-]+)$", key)


def _keys(line: str) -> Found:
    return _named(r"\"([^\"]+)\"\s*:", line)


def _quoted(line: str) -> Found:
    return _named(r"[\"']([A-Za-z0-9_.-]+)\s*(?:[<>=!~;\[(]|[\"'])", line)


#: Base names and what reads them, in order; the first that fits is used.
FILES = (
    (r"(?:docker-compose|compose).*\.ya?ml", lambda: [_compose]),
    (r"package\.json|composer\.json", lambda: [_keys]),
    (r"appsettings.*\.json", lambda: [_urls]),
    (r".*\.csproj", lambda: [lambda line: _named(r"<PackageReference\s+Include\s*=\s*\"([^\"]+)\"", line)]),
    (r"go\.mod", lambda: [lambda line: _named(r"^\s*([^\s()]+)\s+v\d", re.sub(r"^\s*require\s+", "", line))]),
    (r"cargo\.toml", lambda: [_Toml(r"dependencies$")]),
    (r"mix\.exs", lambda: [lambda line: _named(r"\{\s*:([a-z0-9_]+)", line)]),
    (r"gemfile", lambda: [lambda line: _named(r"^\s*gem\s+[\"']([^\"']+)[\"']", line)]),
    (r"requirements.*\.txt", lambda: [_requirements]),
    (r"pipfile", lambda: [_Toml(r"^(?:packages|dev-packages)$")]),
    (r"pyproject\.toml", lambda: [_Toml(r"(?:^|\.)dependencies$"), _quoted]),
    (r"pom\.xml|build\.gradle(?:\.kts)?", lambda: [_maven]),
    (r"database\.yml", lambda: [_rails, _urls]),
    (r"database\.php", lambda: [_php, _urls]),
    (r"application.*\.(?:properties|ya?ml)", lambda: [_urls]),
    (r"settings\.py", lambda: [_django, _urls]),
    (r"\.env\.(?:example|sample|template|dist)", lambda: [_laravel, _urls]),
)


def hints(path: str, text: str) -> list[Hint]:
    """One hint for each engine and line, of several readers the first."""
    base = path.rpartition("/")[2].lower()
    readers = next((make() for pattern, make in FILES if re.fullmatch(pattern, base)), None)
    if readers is None and re.search(r"(?:^|/)settings/[^/]+\.py$", path.lower()):
        readers = [_django, _urls]
    out: dict[tuple[str, int], Hint] = {}
    lines = [line.removesuffix("\r") for line in text.split("\n")] if readers else []
    for reader in readers or []:
        for number, line in enumerate(lines):
            for engine, detail in reader(line):
                if engine:
                    out.setdefault((engine, number), Hint(engine, number, detail))
    return list(out.values())
