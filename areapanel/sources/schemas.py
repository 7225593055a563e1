"""Schemas, code lists and column lists of the landed tables.

The lists below are fixed values of the published data sets.
"""

from __future__ import annotations

# Offence codes per class.
CRIME_CLASSES = {
    "Violent Crime": ["01A", "02", "03", "04A", "04B"],
    "Property Crime": ["05", "06", "07", "09"],
    "Less serious offences": ["01B", "08A", "08B", "10", "11", "12", "13", "14", "15", "16", "17", "18",
                              "19", "20", "22", "24", "26"],
}

# Census variables per attainment level.
# 2017 counts everyone in one block; 2010 counts men and women in two.
EDUCATION_TABLES = {2010: "B15002", 2017: "B15003"}
EDUCATION_LEVELS = {
    2010: {
        "up_to_middle": [
            "B15002_003E", "B15002_004E", "B15002_005E", "B15002_006E", "B15002_020E", "B15002_021E", "B15002_022E",
            "B15002_023E",
        ],
        "not_highschool_grad": [
            "B15002_007E", "B15002_008E", "B15002_009E", "B15002_010E", "B15002_024E", "B15002_025E", "B15002_026E",
            "B15002_027E",
        ],
        "high_school_grad": [
            "B15002_011E", "B15002_028E",
        ],
        "some_college": [
            "B15002_012E", "B15002_013E", "B15002_029E", "B15002_030E",
        ],
        "associate": [
            "B15002_014E", "B15002_031E",
        ],
        "bachelor": [
            "B15002_015E", "B15002_032E",
        ],
        "graduate": [
            "B15002_016E", "B15002_017E", "B15002_018E", "B15002_033E", "B15002_034E", "B15002_035E",
        ],
    },
    2017: {
        "up_to_middle": [
            "B15003_002E", "B15003_003E", "B15003_004E", "B15003_005E", "B15003_006E", "B15003_007E", "B15003_008E",
            "B15003_009E", "B15003_010E", "B15003_011E", "B15003_012E",
        ],
        "not_highschool_grad": [
            "B15003_013E", "B15003_014E", "B15003_015E", "B15003_016E",
        ],
        "high_school_grad": [
            "B15003_017E", "B15003_018E",
        ],
        "some_college": [
            "B15003_019E", "B15003_020E",
        ],
        "associate": [
            "B15003_021E",
        ],
        "bachelor": [
            "B15003_022E",
        ],
        "graduate": [
            "B15003_023E", "B15003_024E", "B15003_025E",
        ],
    },
}

# The years a survey stands for.
SURVEY_YEARS = {
    "2006-2010 5-year estimates": [2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017],
    "2013-2017 5-year estimates": [2018],
}
EDUCATION_SURVEY_YEARS = {2010: [2010, 2011, 2012, 2013, 2014, 2015, 2016, 2017], 2017: [2018]}

# Columns of the rates base.
RATE_COLUMNS = [
    "eviction_filings_total", "eviction_filings_rate", "eviction_filings_completed", "case_type_single_action",
    "case_type_joint_action", "back_rent_median", "back_rent_0", "back_rent_1_to_999", "back_rent_1000_to_2499",
    "back_rent_2500_to_4999", "back_rent_5000_or_more", "landlord_represented", "tenant_represented", "tenant_rep_pa",
    "tenant_rep_laa", "eviction_order_yes", "eviction_order_no", "eviction_order_yes_tenant_prose",
    "eviction_order_no_tenant_prose", "eviction_order_yes_tenant_represented", "eviction_order_no_tenant_represented",
    "eviction_order_yes_tenant_rep_pa", "eviction_order_no_tenant_rep_pa", "eviction_order_yes_tenant_rep_laa",
    "eviction_order_no_tenant_rep_laa", "ftu_eviction_order", "ftu_other_outcome", "ftu_no_outcome",
    "ftu_eviction_order_tenant_prose", "ftu_other_outcome_tenant_prose", "ftu_no_outcome_tenant_prose",
    "ftu_eviction_order_tenant_represented", "ftu_other_outcome_tenant_represented",
    "ftu_no_outcome_tenant_represented", "default_eviction_order_yes", "default_eviction_order_no",
    "default_eviction_order_yes_tenant_prose", "default_eviction_order_no_tenant_prose",
    "default_eviction_order_yes_tenant_represented", "default_eviction_order_no_tenant_represented",
]

# Population groups in the order ties are resolved, and the labels they get.
RACE_ORDER = [("Black", "population_race_black"), ("White", "population_race_white"),
              ("Latin", "population_race_latinx"), ("Asian", "population_race_asian")]
MAJORITY_MINIMUM = 0.4
POOR_LIMIT = 0.3

CRIME_NUMBERS = ["id", "year", "latitude", "longitude"]
CRIME_FLAGS = ["arrest", "domestic"]
VIOLATION_NUMBERS = ["inspection_number", "street_number", "property_group", "latitude", "longitude"]
VIOLATION_DATES = ["violation_date", "violation_status_date", "violation_last_modified_date"]
