import os

from choicelens.plans.statistics import (
    clean_detailed_fuel_table, clean_energy_table, energy_detail_check)
from conftest import rows


def test_detailed_fuel_table(spark, tmp_dir):
    labels = ["Total", "Petrol (excl. hybrids)", "- Below 1400", "- 1400 or over", "Diesel",
              "- Below 1400", "Alternative fuels", "- Hydrogen", "- Electricity", "- LPG"]
    lines = ["New registrations by fuel,,,", "Fuel Type,Country,2020,2021"]
    for country in ("Austria", "Greece", "Atlantis"):
        for i, lab in enumerate(labels):
            v2020 = ".." if (country, lab) == ("Austria", "- LPG") else str(100 + i)
            lines.append(f"{lab},{country},{v2020},{200 + i}")
    p = os.path.join(tmp_dir, "detailed.csv")
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    out = clean_detailed_fuel_table(spark, p)
    got = rows(out.where("TIME_PERIOD = 2020 AND geo = 'AT'"),
               "Motor energy", "Engine capacity of vehicle", "OBS_VALUE")
    assert got == sorted([
        ("Total", "Total", 100.0), ("Petrol", "Total", 101.0), ("Petrol", "Below 1400", 102.0),
        ("Petrol", "1400 or over", 103.0), ("Diesel", "Total", 104.0),
        ("Diesel", "Below 1400", 105.0), ("Electricity", "Total", 108.0),
        ("LPG", "Total", None)], key=lambda t: tuple(str(v) for v in t))
    # hydrogen (unlisted, right after 'Alternative') vanished; names mapped, unknown kept
    assert {r["geo"] for r in out.collect()} == {"AT", "EL", "Unknown"}
    assert out.count() == 3 * 2 * 8


def test_energy_table_and_detail_check(spark):
    rows_ = []
    for y in (2013, 2020, 2021):
        for lab, v in (("Petrol", 100.0), ("Petrol (excluding hybrids)", 60.0),
                       ("Hybrid electric-petrol", 30.0), ("Plug-in hybrid petrol-electric", 10.0),
                       ("Natural gas", 5.0), ("Bi-fuel", 1.0)):
            rows_.append(("x", "A", lab + " ", "AT", "Austria", y, v, None))
    rows_.append(("x", "A", "Petrol", "US", "United States", 2020, 9.0, None))
    df = spark.createDataFrame(rows_, "STRUCTURE string, freq string, `Motor energy` string, "
                                      "geo string, `Geopolitical entity (reporting)` string, "
                                      "TIME_PERIOD int, OBS_VALUE double, OBS_FLAG string")
    clean = clean_energy_table(df)
    assert "STRUCTURE" not in clean.columns and "OBS_FLAG" not in clean.columns
    labs = {r["Motor energy"] for r in clean.collect()}
    assert labs == {"Petrol (all)", "Petrol (excluding hybrids)", "Petrol hybrid",
                    "Petrol plug-in hybrid", "Alternative/Other"}
    assert clean.where("`Motor energy` = 'Alternative/Other'").count() == 4   # 2 labels × 2 years
    chk = rows(energy_detail_check(clean, "Petrol"))
    assert chk == [(2020, 100.0, 100.0, 0.0), (2021, 100.0, 100.0, 0.0)]
