import pytest

from plumbline.sources import (
    SourceSpec,
    file_inventory,
    format_of,
    jdbc_options,
    object_path,
    object_store_conf,
    postgres_url,
    read_path,
    read_sql,
    reads_whole_rows,
    resolve,
    scratch_path,
    source_label,
)

PEOPLE = "id,name,joined\n1,Ann,2021-03-15\n2,,2022-07-01\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "b.csv").write_text(PEOPLE)
    (tmp_path / "a.JSONL").write_text('{"k": 1}\n{"k": 2, "tags": ["x"]}\n')
    (tmp_path / "notes.txt").write_text("no dataset")
    (tmp_path / ".hidden.csv").write_text(PEOPLE)
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "c.json").write_text('{"k": 3}\n')
    return tmp_path


@pytest.mark.parametrize(
    "path, fmt",
    [("a.csv", "csv"), ("s3a://b/k.PARQUET?v=1.txt", "parquet"), ("x/y.jsonl", "json"), ("d/t.json/", "json")],
)
def test_format_follows_the_extension(path, fmt):
    assert format_of(path) == fmt


@pytest.mark.parametrize("path", ["a.txt", "noext", "a.csv.gz", ""])
def test_other_formats_are_rejected(path):
    with pytest.raises(ValueError):
        format_of(path)


def test_csv_types_are_inferred(spark, folder):
    df = read_path(spark, str(folder / "b.csv"))
    assert df.dtypes == [("id", "int"), ("name", "string"), ("joined", "date")]
    assert df.filter("name IS NULL").count() == 1
    given = read_path(spark, str(folder / "b.csv"), schema="id BIGINT, name STRING, joined STRING")
    assert given.dtypes[0] == ("id", "bigint") and given.count() == 2


def test_json_lines(spark, folder):
    df = read_path(spark, str(folder / "a.JSONL"))
    assert dict(df.dtypes) == {"k": "bigint", "tags": "array<string>"}


def test_inventory(spark, folder):
    listed = file_inventory(spark, str(folder), active=str(folder / "b.csv")).collect()
    assert [(r["name"], r["ext"], r["active"]) for r in listed] == [("a.JSONL", "jsonl", False), ("b.csv", "csv", True)]
    assert listed[1]["path"] == str(folder / "b.csv")
    assert listed[1]["size_kb"] == round(len(PEOPLE) / 1024, 1)
    deep = file_inventory(spark, f"file://{folder}", recursive=True).collect()
    assert [r["name"] for r in deep] == ["a.JSONL", "b.csv", "deeper/c.json"]


def test_resolve(spark, folder):
    root = {"root": str(folder)}
    assert resolve(spark, SourceSpec("local", "b.csv", root)).count() == 2
    assert resolve(spark, SourceSpec("local", None, root)).columns == ["k", "tags"]
    assert resolve(spark, SourceSpec("local", str(folder / "b.csv"))).count() == 2
    for source in (
        SourceSpec("local", "../b.csv", root),
        SourceSpec("local", "..", root),
        SourceSpec("local"),
        SourceSpec("minio"),
        SourceSpec("postgres", " "),
        SourceSpec("ftp", "x"),
        SourceSpec("local", "notes.txt", root),
    ):
        with pytest.raises(ValueError):
            resolve(spark, source)


def test_local_root_without_datasets(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        resolve(spark, SourceSpec("local", None, {"root": str(tmp_path)}))


def test_labels():
    assert source_label(SourceSpec("local", "/data/a.csv")) == "a.csv"
    assert source_label(SourceSpec("minio", "s3a://b/x/y.parquet")) == "y.parquet"
    assert source_label(SourceSpec("postgres", "SELECT 1")) == "SELECT 1"


def test_reads_whole_rows():
    assert not reads_whole_rows(SourceSpec("local", "a.parquet"))
    assert reads_whole_rows(SourceSpec("local", "a.csv"))
    assert reads_whole_rows(SourceSpec("postgres", "t"))


def test_object_store_settings():
    assert object_path("b", " x/y.csv ") == "s3a://b/x/y.csv"
    with pytest.raises(ValueError):
        object_path("b", " ")
    conf = object_store_conf("http://host:9000", "user", "secret")
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://host:9000"


# No database is at hand here, so the readers are covered up to their options.


def test_jdbc_table_and_query():
    url = postgres_url("host", "db")
    assert url == "jdbc:postgresql://host:5432/db"
    assert jdbc_options(url, "public.t", user="u")["dbtable"] == "public.t"
    assert jdbc_options(url, " select a from t; ")["dbtable"] == "(select a from t) t"
    assert jdbc_options(url, "WITH x AS (SELECT 1) SELECT * FROM x")["dbtable"].startswith("(WITH")
    assert jdbc_options(url, "SELECT*FROM t")["dbtable"] == "(SELECT*FROM t) t"
    assert jdbc_options(url, "selections")["dbtable"] == "selections"
    assert "user" not in jdbc_options(url, "t")
    with pytest.raises(ValueError):
        jdbc_options(url, "  ")


def test_jdbc_partitioned_read():
    options = jdbc_options("u", "t", partition_column="id", lower_bound=0, upper_bound=100, num_partitions=4)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4" and options["lowerBound"] == "0"
    with pytest.raises(ValueError):
        jdbc_options("u", "t", partition_column="id")


def test_sql(spark):
    table = spark.range(3)
    assert read_sql(spark, "SELECT id FROM nums WHERE id > 0", {"nums": table}).count() == 2
    assert not spark.catalog.tableExists("nums")
    spark.range(5).createOrReplaceTempView("nums")
    assert read_sql(spark, "nums", {"nums": table}).count() == 3
    assert read_sql(spark, "nums").count() == 5
    spark.catalog.dropTempView("nums")
    assert read_sql(spark, "with x as (select 1 as a) select * from x").count() == 1
    with pytest.raises(ValueError):
        read_sql(spark, " ")


def test_scratch_paths(spark):
    first, second = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert first != second and first.endswith("-t")


class _Session:
    """As much of a session as the scratch folder depends on."""

    def __init__(self, **settings):
        self.conf = self
        self._settings = {k.replace("_", "."): v for k, v in settings.items()}

    def get(self, key, default=None):
        return self._settings.get(key, default)


def test_scratch_follows_the_cluster():
    shared = _Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/")
    assert scratch_path(shared, "t").startswith("hdfs:///shared/")
    with pytest.raises(RuntimeError):
        scratch_path(_Session(spark_master="yarn"), "t")
