"""Schemas of the landed tables."""

OCCUPANCY = "source_file string, year int, period string, state string, average_occupancy_rate_pct double"
INVENTORY = "source_file string, year int, period string, state string, hotels_count double, rooms_count bigint"
GUESTS = (
    "source_file string, year int, period string, state string, domestic_guests bigint, foreign_guests bigint, total_guests bigint"
)
CALENDAR = (
    "month string, cuti_sekolah_days int, public_holidays int, long_weekends int, demand_multiplier double, event_highlights string"
)
HOLIDAYS = "holiday_name string, holiday_date date, notes string"
HOUSEHOLDS = (
    "date string, state string, income_mean double, income_median double, expenditure_mean double, gini double, poverty double"
)
VISITORS_LONG = "state string, year int, domestic_visitors_000 bigint"
SURVEY_SERIES = "state string, year int, domestic_visitors_thousands double"
ORIGIN_DESTINATION = "origin_state string, destination_state string, tourists_thousands double"
RANKED_DISTRICTS = "year int, state string, rank int, district_name string"
RANKED_ATTRACTIONS = "year int, state string, rank int, attraction_name string"
PLANNING_REGIONS = "state string, planning_region string"
HOTEL_SUPPLY = "state string, hotels_2023 bigint, hotel_rooms_2023 bigint"
PILOT = (
    "corridor_id int, corridor_name string, destination_type string, destination_name string, district_name string, "
    "state_name string, resident_population bigint, total_rooms bigint, daily_demand_peak double, cc_accommodation double, "
    "cc_transport double, cc_attraction double, cc_water_waste double, cc_ecology double, cc_social double, "
    "binding_constraint string, sustainable_capacity double, continuous_pressure double, excess_demand_daily double, "
    "capacity_gap double, mean_household_income double, median_household_income double, poverty_rate double, "
    "arch_heritage double, arch_nature double, arch_beach double, arch_food double, arch_urban double, transit_mode string, "
    "transit_time_mins int, transit_fare_rm double, pbt_name string"
)
ZONES = (
    "ksas_code string, jenis_ksas string, tahap string, nama string, luas_h double, akt_1 string, akt_syarat string, "
    "akt_0 string, negeri string, daerah string, bp string, bpk string, tahun_data int, lat double, lon double, radius_m int, "
    "area_derived boolean, radius_basis string, sumber string, representation string, keyakinan string, label_peta string, "
    "key string"
)
STATE_BASELINE = (
    "state string, domestic_visitors_2024_000 double, domestic_visitors_2023_000 double, overnight_tourists_2024_000 double, "
    "population_2024_000 double, median_household_income_2024_rm double, mean_household_income_2024_rm double, "
    "poverty_rate_2024_pct double, gini_2024 double, hotels_2023 double, hotel_rooms_2023 double, visitor_growth_2024_pct double, "
    "annual_visitors_per_resident double, annual_overnight_tourists_per_room double, tourism_pressure_proxy_score double, "
    "spare_capacity_proxy_score double, community_opportunity_proxy_score double, redistribution_potential_proxy_score double"
)
INTEREST = (
    "destination string, state string, district string, category string, relative_search_index double, peak_month string, "
    "dominant_query string, method string"
)
CELLS = "year int, sheet string, row int, col int, value string"
RIDERSHIP = "date date, rail_ets double, rail_komuter_utara double, rail_komuter double, rail_intercity double, bus_rpn double"
MULTIPLIER_TABLES = (
    "map<string, struct<year: int, composite_tourism: struct<type1_output_multiplier: double, type1_gva_multiplier: double, "
    "type2_output_multiplier: double, type2_gva_multiplier: double>, sectors: map<string, struct<code: int, name: string, "
    "dosm_name: string, type1_output: double, type1_gva: double, type2_output: double, type2_gva: double>>>>"
)
ROUTES = (
    "map<string, struct<corridor_name: string, mode: string, travel_time_mins: double, fare_rm: double, "
    "waypoints: array<array<double>>>>"
)
