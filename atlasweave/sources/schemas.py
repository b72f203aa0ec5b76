"""Schemas of source rows, units and venues: fixed on reading, so nothing is inferred from 100 TB."""

OFFICIAL = "name string, address string, lat double, lng double, region_code string, region_label string, sid string, paseli boolean"
COMMUNITY = (
    "name string, name_en string, address string, lat double, lng double, coord_system string, games array<string>, source string, source_url string, notes string, country string, "
    "game_counts map<string,int>, count_evidence map<string,string>, cab_models map<string,int>, hours string, game_prices map<string,string>, game_versions map<string,string>, is_open boolean, street string, sid string, website string, info_text string"
)
UNIT = "unit_id long, source string, name string, addr string, lat double, lng double, games array<string>, cabs array<string>, country string, pref string, notes array<string>, source_url string, game_counts map<string,int>, count_evidence map<string,string>"
CORRUPT = "_corrupt_record string"
