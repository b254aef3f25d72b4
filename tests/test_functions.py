import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from edurank.functions import text
from edurank.functions.numeric import exact_avg, round_even, to_int_even, to_number_5_2


def test_round_even_equals_python(spark):
    rng = random.Random(7)
    values = [rng.randint(0, 10_000) / 100 / rng.choice([1, 2, 3, 4, 8]) for _ in range(3000)]
    values += [(rng.randint(0, 10_000) + rng.randint(0, 10_000)) / 200 for _ in range(3000)]
    values += [-rng.randint(0, 1000) / 1000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.selectExpr(
        "x", f"{round_even('x', 2)} as r2", f"{round_even('x', 6)} as r6", f"{to_int_even('x')} as i"
    ).collect()
    assert all(r.r2 == round(r.x, 2) and r.r6 == round(r.x, 6) and r.i == round(r.x) for r in rows)


def test_exact_average_rounds_half_up(spark):
    df = spark.sql("select inline(array(struct(0.10 as x), struct(0.11 as x)))")
    assert df.agg(F.expr(exact_avg("x", 2))).first()[0] == Decimal("0.11")
    assert df.where("x > 1").agg(F.expr(exact_avg("x", 2))).first()[0] is None


def test_number_5_2_is_clamped(spark):
    df = spark.createDataFrame([(5000.0,), (-5000.0,), (1.005,), (None,)], "x double")
    got = [r[0] for r in df.selectExpr(to_number_5_2("x")).collect()]
    assert got == [Decimal("999.99"), Decimal("-999.99"), Decimal("1.00"), None]


CASES = [
    (text.municipality_name, "г.Артем", "город Артем"),
    (text.municipality_name, "Город  Артем", "город Артем"),
    (text.municipality_name, "nan", ""),
    (text.municipality_name, " г. Артём ", "город Артём"),
    (text.municipality_key, "(12) Округ", "012"),
    (text.municipality_key, "г. Ёлкино", "город елкино"),
    (text.school_code3, "(286) МБОУ", "286"),
    (text.school_code3, "(8) МБОУ", "008"),
    (text.school_code3, "138049 - МБОУ", "138"),
    (text.school_code3, "Школа", None),
    (text.standard_school_name, "(286) МБОУ СОШ №14 г.Артёма", "286 МБОУ СОШ № 14 Г. АРТЕМА"),
    (
        text.standard_school_name,
        "Муниципальное бюджетное общеобразовательное учреждение «Средняя школа № 5»",
        "МБОУ СРЕДНЯЯ ШКОЛА № 5",
    ),
    (
        text.standard_school_name,
        "муниципальное казённое нетиповое общеобразовательное учреждение, с.Нелькан",
        "МКОУ НЕТИПОВОЕ, С. НЕЛЬКАН",
    ),
    (text.standard_school_name, "138049 – Школа +B116", "ШКОЛА"),
    (text.standard_school_name, "краяМБОУ лицей", "КРАЯ МБОУ ЛИЦЕЙ"),
    (text.standard_school_name, "Частное общеобразовательное учреждение имни Гагарина", "ЧОУ ИМЕНИ ГАГАРИНА"),
    (text.school_key, "МБОУ СОШ № 1 Приморского района", "МБОУСОШ1ПРИМОРСКИЙРАЙОНА"),
    (text.duplicate_name_key, "(3) МБОУ  СОШ № 3  Приморского", "мбоусош3приморский"),
    (text.subject_title, "Информатика и ИКТ, чел.", "ИКТ"),
    (text.subject_title, "русский язык (база)", "Русский язык"),
    (text.subject_title, "Прочее", "Прочее"),
    (text.profile_tokens, "Физико математический; универсальный, х - отсутствует", ["физико-математический", "универсальный"]),
    (text.profile_tokens, "нет", []),
    (text.profile_tokens, "«Тенологический»; ТЕХНОЛОГИЧЕСКИЙ", ["технологический"]),
    (text.to_int, "12,0", 12),
    (text.to_int, "-", None),
    (text.to_int, "nan", None),
    (text.to_int, " 7.9 ", 7),
    (text.to_decimal_2, "56,785", Decimal("56.79")),
    (text.region_of_file, "/in/directories_Приморский_край.xlsx", "Приморский край"),
    (text.year_of_sheet, "ЕГЭ 2023", 2023),
    (text.dataset_kind, "План", "plan"),
    (text.dataset_kind, "2", "actual"),
    (text.is_primorsky, "Край Приморский", True),
    (text.program_subject, "информатика и икт", "ИКТ"),
    (text.strip_outer_quotes, "«'a b'»", "a b"),
    (text.strip_outer_quotes, "« \"a\" b »", "a\" b"),
    (text.strip_outer_quotes, "«\"A", "\"A"),
    (text.strip_outer_quotes, "'A»", "A"),
]


@pytest.mark.parametrize("rule", sorted({c[0].__name__ for c in CASES}))
def test_text_rules(spark, rule):
    cases = [(given, expected) for f, given, expected in CASES if f.__name__ == rule]
    df = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(cases)], "i int, x string")
    got = [r[0] for r in df.select(getattr(text, rule)(F.col("x")), "i").orderBy("i").collect()]
    assert got == [expected for _, expected in cases]
