"""Similarity of strings and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import local_part, norm


def common_length(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence of two strings, row by row of the usual table."""
    return f"""aggregate(
        filter(split({a}, ''), x -> x <> ''), array_repeat(0, char_length({b}) + 1),
        (row, ch) -> aggregate(sequence(1, char_length({b}) + 1), array(0),
            (out, j) -> if(j > char_length({b}), out,
                array_append(out, if(substring({b}, j, 1) = ch, row[j - 1] + 1, greatest(row[j], out[j - 1]))))),
        row -> row[char_length({b})])"""


def ratio(a: str, b: str) -> Column:
    """Twice the common subsequence over both lengths: 1 for equal strings, two empty ones included. a, b: column names."""
    both = f"(char_length({a}) + char_length({b}))"
    return F.expr(f"if({a} = {b}, 1D, if({both} = 0, 1D, 2D * {common_length(a, b)} / {both}))")


def token_sorted(value: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(value), r"\s+")), " ")


def identifier_score(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when(F.levenshtein(a, b, 2) >= 0, 0.85).otherwise(0.0)


def keys_contradict(a: Column, b: Column) -> Column:
    """Both set, unequal, and neither the beginning of the other."""
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (x != y) & ~x.startswith(y) & ~y.startswith(x)


def similarity(left: str, right: str) -> Column:
    """Likeness of two records, held in struct columns: contradicting keys, e-mails, phones, then names with birth dates."""
    get = lambda side, f: norm(F.col(side)[f])
    both = lambda f: (get(left, f) != "") & (get(right, f) != "")
    nameless = lambda s: (get(s, "first_name") == "") & (get(s, "last_name") == "")
    sql = lambda s, f: f"coalesce(lower(trim({s}.{f})), '')"
    part = {f: (get(left, f) != "") | (get(right, f) != "") for f in ("first_name", "last_name")}
    total = sum(F.when(cond, ratio(sql(left, f), sql(right, f))).otherwise(0.0) for f, cond in part.items())
    count = sum(F.when(cond, 1).otherwise(0) for cond in part.values())
    births = both("date_of_birth") & (get(left, "date_of_birth") != get(right, "date_of_birth"))
    return (
        F.when(keys_contradict(F.col(left)["employee_id"], F.col(right)["employee_id"]), 0.0)
        .when(both("work_email"), identifier_score(local_part(get(left, "work_email")), local_part(get(right, "work_email"))))
        .when(both("phone"), identifier_score(get(left, "phone"), get(right, "phone")))
        .when(nameless(left) | nameless(right), 0.0)
        .when(births, 0.0)
        .otherwise(F.try_divide(total, count))
    )


def blocking_key(email: Column, first: Column, last: Column, phone: Column) -> Column:
    e, f, n, p = norm(email), norm(first), norm(last), norm(phone)
    return F.coalesce(
        F.when(e != "", F.concat(F.lit("em:"), F.substring(local_part(e), 1, 5))),
        F.when(n != "", F.concat(F.lit("ln:"), F.substring(n, 1, 6), F.lit(":"), F.substring(f, 1, 1))),
        F.when(p != "", F.concat(F.lit("ph:"), F.right(p, F.lit(4)))),
        F.lit("_no_identity_"),
    )
