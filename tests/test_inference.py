import pytest

from castwright import apply_overrides, infer, infer_table, profile
from castwright import fixed
from castwright.operators.overrides import OverrideError, can_convert_matrix, check_overrides, unknown_columns


def table(spark, columns):
    names = list(columns)
    rows = [(i, *cells) for i, cells in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, "row long, " + ", ".join(f"`{n}` string" for n in names))


def schema_of(spark, columns, **options):
    return {r["column"]: r for r in infer_table(table(spark, columns), "row", list(columns), **options).collect()}


def test_boolean_ambiguous_date_and_category(spark):
    found = schema_of(
        spark,
        {
            "is_active": ["yes", "no"] * 10,
            "event_date": ["01/02/2020", "02/03/2020"] * 10,
            "segment": ["enterprise"] * 12 + ["self-serve"] * 8,
        },
    )
    assert found["is_active"]["inferred_type"] == "boolean"
    assert found["event_date"]["inferred_type"] == "text"
    assert found["event_date"]["warnings"] == [fixed.WARN_AMBIGUOUS]
    assert found["segment"]["inferred_type"] == "category"
    assert found["segment"]["confidence"] == 0.76


def test_small_sample_category(spark):
    found = schema_of(spark, {"grade": list("ABABA"), "name": ["Ann", "Bob", "Cid", "Dee", "Eve"]})
    assert (found["grade"]["inferred_type"], found["grade"]["confidence"]) == ("category", 0.64)
    assert (found["name"]["inferred_type"], found["name"]["confidence"]) == ("text", 0.45)


def test_unsafe_override_is_rejected(spark):
    found = profile(table(spark, {"mixed": ["1", "two", "3"]}), "row", ["mixed"])
    with pytest.raises(OverrideError, match="Column 'mixed' cannot be safely converted to 'integer'."):
        apply_overrides(infer(found), found, {"mixed": "integer"})


def test_override_errors_in_order(spark):
    found = profile(table(spark, {"a": ["1", "2"], "d": ["01/02/2020", "03/04/2020"]}), "row", ["a", "d"])
    checked = check_overrides(found, {"zzz": "text", "a": "money", "d": "integer"}).orderBy("position").collect()
    assert [r["error"] for r in checked] == [
        "Column 'zzz' does not exist in the dataset.",
        "Unsupported override type 'money'.",
        "Column 'd' cannot be safely converted to 'integer'.",
    ]
    assert [r["column"] for r in unknown_columns(found, {"zzz": "text", "a": "text"}).collect()] == ["zzz"]
    with pytest.raises(OverrideError, match="does not exist"):
        apply_overrides(infer(found), found, {"zzz": "text", "a": "money"})


def test_forced_date_changes_type_and_warning_only(spark):
    found = profile(table(spark, {"d": ["01/02/2020", "03/04/2020"], "n": ["1", "2"]}), "row", ["d", "n"])
    row, other = apply_overrides(infer(found), found, {"d": "date", "n": "float"}).collect()
    assert (row["inferred_type"], row["storage_type"], row["display_type"]) == ("date", "datetime64[ns]", "Date")
    assert row["warnings"] == [fixed.WARN_FORCED] and row["confidence"] == 0.3
    assert row["sample_values"] == ["01/02/2020", "03/04/2020"]
    assert (other["inferred_type"], other["storage_type"], other["confidence"]) == ("float", "Float64", 0.98)


def test_decision_ladder(spark):
    found = schema_of(
        spark,
        {
            "zero_one": ["0", "1", "0"],
            "mixed_bool": ["0", "1", "yes"],
            "grouped": ["1,000", "2", "N/A"],
            "decimal": ["1.5", "2", "3"],
            "day": ["2020-01-02", "13/02/2020", "Jan 5, 2020"],
            "stamp": ["2020-01-02", "2020-01-02 10:00", "12:30"],
            "z": ["1+2j", "j", "(3-4J)"],
            "empty": ["", "null", " NaN "],
        },
    )
    assert {c: r["inferred_type"] for c, r in found.items()} == {
        "zero_one": "integer", "mixed_bool": "boolean", "grouped": "integer", "decimal": "float",
        "day": "date", "stamp": "datetime", "z": "complex", "empty": "text",
    }
    assert found["empty"]["warnings"] == [fixed.WARN_EMPTY] and found["empty"]["confidence"] == 0.1
    assert found["grouped"]["nullable"] and found["grouped"]["null_token_count"] == 1
    assert found["grouped"]["allowed_overrides"] == fixed.LOGICAL_TYPES


def test_ambiguity_is_sticky(spark):
    found = schema_of(spark, {"d": ["13/02/2020", "01/02/2020"]})
    assert found["d"]["confidence"] == 0.3


def test_empty_table_keeps_defaults(spark):
    empty = table(spark, {"a": ["x"], "b": ["y"]}).where("false")
    rows = profile(empty, "row", ["a", "b"]).orderBy("pos").collect()
    assert [r["column"] for r in rows] == ["a", "b"]
    for r in rows:
        assert r["total_count"] == 0 and r["unique_count"] == 0 and r["sample_values"] == []
        assert r["integer_valid"] and r["datetime_valid"] and r["complex_valid"] and r["boolean_valid"]
        assert not (r["boolean_has_alpha_tokens"] or r["ambiguous_datetime"] or r["has_time_component"])


def test_can_convert_matrix(spark):
    found = profile(table(spark, {"a": ["1", "0"], "t": ["x", "y"]}), "row", ["a", "t"])
    allowed = {(r["column"], r["target_type"]) for r in can_convert_matrix(found).collect() if r["allowed"]}
    assert allowed == {
        ("a", "text"), ("a", "integer"), ("a", "float"), ("a", "boolean"), ("a", "category"),
        ("t", "text"), ("t", "category"),
    }


def test_odd_column_names(spark):
    found = schema_of(spark, {"a.b": ["1", "2"], "c d": ["x", "y"], "e(f)": ["1.5", "2"]})
    assert [found[c]["inferred_type"] for c in ("a.b", "c d", "e(f)")] == ["integer", "text", "float"]
