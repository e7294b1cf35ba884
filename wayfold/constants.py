"""Vocabularies, weights and thresholds of the domain."""

from __future__ import annotations

# Fixed values of the data model.
PURPOSES = ("데이트", "친구모임", "혼자", "가족", "작업", "회식")
ATMOSPHERES = ("조용한", "활기찬", "감성적인", "트렌디한", "로컬한", "넓은", "뷰가좋은", "아늑한", "이국적인", "가성비")
WEATHER_STATES = ("맑음", "비", "미세먼지나쁨", "폭염한파")
CONGESTION = ("여유", "보통", "약간 붐빔", "붐빔")
ZONES = ("itaewon", "yongsan_stn", "huam", "ichon", "cheongpa")
AGE_BANDS = (10, 20, 30, 40, 50, 60)
HOUR_BAND_STARTS = (0, 6, 11, 14, 17, 21)

# Fixed values of the score.
WEIGHTS = {
    "segment_affinity": 0.22,
    "purpose_match": 0.22,
    "taste_similarity": 0.16,
    "context_fit": 0.13,
    "quality": 0.09,
    "live_segment_match": 0.10,
    "crowd_fit": 0.08,
}
DISTANCE_WEIGHT = 0.05
NEUTRAL = 0.5
DISTANCE_NORM_M = 2000.0
ZONE_RESISTANCE = {
    ("itaewon", "yongsan_stn"): 1.4,
    ("itaewon", "huam"): 1.6,
    ("itaewon", "ichon"): 2.2,
    ("itaewon", "cheongpa"): 2.0,
    ("yongsan_stn", "huam"): 1.5,
    ("yongsan_stn", "ichon"): 1.1,
    ("yongsan_stn", "cheongpa"): 1.2,
    ("huam", "ichon"): 2.5,
    ("huam", "cheongpa"): 1.4,
    ("ichon", "cheongpa"): 1.9,
}
CROWD_QUIET = {"여유": 1.0, "보통": 0.8, "약간 붐빔": 0.5, "붐빔": 0.2}
CROWD_LIVELY = {"여유": 0.6, "보통": 0.9, "약간 붐빔": 1.0, "붐빔": 0.8}
QUIET_PURPOSES = ("데이트", "혼자", "작업")
LIVELY_PURPOSES = ("친구모임", "회식")
CROWD_NEUTRAL = 0.8
AGE_BASELINE = {10: 0.047717, 20: 0.272665, 30: 0.226391, 40: 0.167909, 50: 0.133623, 60: 0.084339}
RAIN_COEFFICIENT = {1: 0.5, 2: 0.7, 3: 0.9}
PM25_BOUNDS, PM10_BOUNDS = (15, 35, 75), (30, 80, 150)
AIR_GRADES = {"좋음": 1, "보통": 2, "나쁨": 3, "매우나쁨": 4}

# Fixed values of service responses.
AGE_RATES = (0, 10, 20, 30, 40, 50, 60, 70)
NOT_WEATHER_NOW = ("FCST24HOURS", "NEWS_LIST")
SKY = {1: "맑음", 3: "구름많음", 4: "흐림"}
PRECIPITATION = {0: "없음", 1: "비", 2: "비/눈", 3: "눈", 4: "소나기", 5: "빗방울", 6: "빗방울눈날림", 7: "눈날림"}

# Fixed values of candidate search.
RADII = (1200.0, 1920.0, 3072.0)
MIN_CANDIDATES, RELAX_BELOW, NEAREST = 30, 3, 3
CONFIDENCE, CONFIDENCE_RELAXED = 0.30, 0.15
CANDIDATE_LIMIT, TOP_N, SHOWN = 500, 20, 4
EARTH_RADIUS_M = 6_371_000.0

# Fixed values of curation.
QUALITY_PRIOR = 8.0
QUOTA_TOTAL = 800
RELEVANCE_MIN = 4

#: Rough centres of the zones (public geography), used as anchors and request places.
ANCHORS = {
    "itaewon": (37.5340, 126.9946),
    "yongsan_stn": (37.5298, 126.9648),
    "huam": (37.5485, 126.9775),
    "ichon": (37.5225, 126.9735),
    "cheongpa": (37.5445, 126.9675),
}
