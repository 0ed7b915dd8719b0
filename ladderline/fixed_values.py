"""Fixed values.

Everything in this module is a fixed value: the numbers, codes and names must be exactly these
for results to agree with the published rating method. Nothing here is computed.
"""

from __future__ import annotations

# Rating parameters.
INITIAL_RATING = 1500.0
K_FACTOR = 24.0
HOME_ADVANTAGE = 65.0
SEASON_REGRESSION = 0.15
SEASON_GAP_DAYS = 60

# K multiplier per league.
LEAGUE_STRENGTH = {
    "PL": 1.15,
    "PD": 1.05,
    "BL1": 1.00,
    "SA": 1.00,
    "FL1": 0.85,
}

# Starting rating and regression target per league.
LEAGUE_BASELINE = {
    "PL": 1600.0,
    "PD": 1515.0,
    "BL1": 1500.0,
    "SA": 1500.0,
    "FL1": 1470.0,
}

# Leagues in report order with country code and label.
LEAGUE_COUNTRY = {
    "PL": "ENG",
    "PD": "ESP",
    "BL1": "GER",
    "SA": "ITA",
    "FL1": "FRA",
}
LEAGUE_LABEL = {
    "PL": "Premier League",
    "PD": "La Liga",
    "BL1": "Bundesliga",
    "SA": "Serie A",
    "FL1": "Ligue 1",
}

# Competition code in a season file name -> league.
COMPETITION_LEAGUE = {
    "E0": "PL",
    "SP1": "PD",
    "D1": "BL1",
    "I1": "SA",
    "F1": "FL1",
}

# First match id given to rows that carry no id of their own.
FIRST_MATCH_ID = 1_000_000

# External ranking (team, rating, rank).
EXTERNAL_RANKING = [
    ("Arsenal", 2052, 1),
    ("Bayern Munich", 1996, 2),
    ("Manchester City", 1983, 3),
    ("Paris Saint-Germain", 1969, 4),
    ("Barcelona", 1949, 5),
    ("Liverpool", 1941, 6),
    ("Inter Milan", 1926, 7),
    ("Aston Villa", 1924, 8),
    ("Real Madrid", 1917, 9),
    ("Chelsea", 1883, 10),
    ("Atlético Madrid", 1871, 11),
    ("Napoli", 1864, 12),
    ("Bayer Leverkusen", 1861, 13),
    ("Newcastle", 1842, 14),
    ("AC Milan", 1838, 15),
    ("Juventus", 1830, 16),
    ("Tottenham", 1828, 17),
    ("Borussia Dortmund", 1822, 18),
    ("Brighton", 1808, 19),
    ("Marseille", 1800, 20),
]

# Team -> name used by the external ranking.
EXTERNAL_NAMES = {
    "Arsenal FC": "Arsenal",
    "FC Bayern München": "Bayern Munich",
    "Manchester City FC": "Manchester City",
    "Paris Saint-Germain FC": "Paris Saint-Germain",
    "FC Barcelona": "Barcelona",
    "Liverpool FC": "Liverpool",
    "FC Internazionale Milano": "Inter Milan",
    "Aston Villa FC": "Aston Villa",
    "Real Madrid CF": "Real Madrid",
    "Chelsea FC": "Chelsea",
    "Club Atlético de Madrid": "Atlético Madrid",
    "SSC Napoli": "Napoli",
    "Bayer 04 Leverkusen": "Bayer Leverkusen",
    "Newcastle United FC": "Newcastle",
    "AC Milan": "AC Milan",
    "Juventus FC": "Juventus",
    "Tottenham Hotspur FC": "Tottenham",
    "Borussia Dortmund": "Borussia Dortmund",
    "Brighton & Hove Albion FC": "Brighton",
    "Olympique de Marseille": "Marseille",
}

# Teams flagged in the before/after comparison.
KEY_TEAMS = [
    "Arsenal",
    "Paris Saint-Germain",
    "AS Roma",
    "Bayern Munich",
    "Manchester City",
    "Liverpool",
    "Barcelona",
    "Real Madrid",
    "Inter Milan",
]

# Club name in the season files -> canonical club name.
CLUB_NAMES = {
    "Ajaccio GFCO": "GFC Ajaccio",
    "Alaves": "Deportivo Alavés",
    "Almeria": "UD Almería",
    "Angers": "Angers SCO",
    "Arsenal": "Arsenal FC",
    "Aston Villa": "Aston Villa FC",
    "Atalanta": "Atalanta BC",
    "Ath Bilbao": "Athletic Club",
    "Ath Madrid": "Club Atlético de Madrid",
    "Augsburg": "FC Augsburg",
    "Auxerre": "AJ Auxerre",
    "Barcelona": "FC Barcelona",
    "Bastia": "SC Bastia",
    "Bayern Munich": "FC Bayern München",
    "Betis": "Real Betis Balompié",
    "Bochum": "VfL Bochum 1848",
    "Bologna": "Bologna FC 1909",
    "Bordeaux": "FC Girondins de Bordeaux",
    "Bournemouth": "AFC Bournemouth",
    "Brentford": "Brentford FC",
    "Brest": "Stade Brestois 29",
    "Brighton": "Brighton & Hove Albion FC",
    "Burnley": "Burnley FC",
    "Cadiz": "Cádiz CF",
    "Caen": "SM Caen",
    "Cagliari": "Cagliari Calcio",
    "Carpi": "Carpi FC 1909",
    "Celta": "RC Celta de Vigo",
    "Chelsea": "Chelsea FC",
    "Chievo": "AC Chievo Verona",
    "Clermont": "Clermont Foot 63",
    "Como": "Como 1907",
    "Crystal Palace": "Crystal Palace FC",
    "Darmstadt": "SV Darmstadt 98",
    "Dortmund": "Borussia Dortmund",
    "Eibar": "SD Eibar",
    "Ein Frankfurt": "Eintracht Frankfurt",
    "Empoli": "Empoli FC",
    "Espanol": "RCD Espanyol de Barcelona",
    "Everton": "Everton FC",
    "FC Koln": "1. FC Köln",
    "Fiorentina": "ACF Fiorentina",
    "Freiburg": "SC Freiburg",
    "Frosinone": "Frosinone Calcio",
    "Fulham": "Fulham FC",
    "Genoa": "Genoa CFC",
    "Getafe": "Getafe CF",
    "Girona": "Girona FC",
    "Granada": "Granada CF",
    "Guingamp": "EA Guingamp",
    "Hamburg": "Hamburger SV",
    "Hannover": "Hannover 96",
    "Heidenheim": "1. FC Heidenheim 1846",
    "Hertha": "Hertha BSC",
    "Hoffenheim": "TSG 1899 Hoffenheim",
    "Ingolstadt": "FC Ingolstadt 04",
    "Inter": "FC Internazionale Milano",
    "Ipswich": "Ipswich Town FC",
    "Juventus": "Juventus FC",
    "La Coruna": "RC Deportivo de La Coruña",
    "Las Palmas": "UD Las Palmas",
    "Lazio": "SS Lazio",
    "Le Havre": "Le Havre AC",
    "Lecce": "US Lecce",
    "Leganes": "CD Leganés",
    "Leicester": "Leicester City FC",
    "Lens": "Racing Club de Lens",
    "Levante": "Levante UD",
    "Leverkusen": "Bayer 04 Leverkusen",
    "Lille": "Lille OSC",
    "Liverpool": "Liverpool FC",
    "Lorient": "FC Lorient",
    "Luton": "Luton Town FC",
    "Lyon": "Olympique Lyonnais",
    "M'gladbach": "Borussia Mönchengladbach",
    "Mainz": "1. FSV Mainz 05",
    "Malaga": "Málaga CF",
    "Mallorca": "RCD Mallorca",
    "Man City": "Manchester City FC",
    "Man United": "Manchester United FC",
    "Marseille": "Olympique de Marseille",
    "Metz": "FC Metz",
    "Milan": "AC Milan",
    "Monaco": "AS Monaco FC",
    "Montpellier": "Montpellier HSC",
    "Monza": "AC Monza",
    "Nantes": "FC Nantes",
    "Napoli": "SSC Napoli",
    "Newcastle": "Newcastle United FC",
    "Nice": "OGC Nice",
    "Norwich": "Norwich City FC",
    "Nott'm Forest": "Nottingham Forest FC",
    "Osasuna": "CA Osasuna",
    "Palermo": "US Città di Palermo",
    "Paris SG": "Paris Saint-Germain FC",
    "Parma": "Parma Calcio 1913",
    "Real Madrid": "Real Madrid CF",
    "Reims": "Stade de Reims",
    "Rennes": "Stade Rennais FC 1901",
    "Roma": "AS Roma",
    "Salernitana": "US Salernitana 1919",
    "Sampdoria": "UC Sampdoria",
    "Sassuolo": "US Sassuolo Calcio",
    "Schalke 04": "FC Schalke 04",
    "Sevilla": "Sevilla FC",
    "Sheffield United": "Sheffield United FC",
    "Sociedad": "Real Sociedad de Fútbol",
    "Southampton": "Southampton FC",
    "Sp Gijon": "Real Sporting de Gijón",
    "St Etienne": "AS Saint-Étienne",
    "St Pauli": "FC St. Pauli 1910",
    "Stoke": "Stoke City FC",
    "Strasbourg": "RC Strasbourg Alsace",
    "Stuttgart": "VfB Stuttgart",
    "Sunderland": "Sunderland AFC",
    "Swansea": "Swansea City AFC",
    "Torino": "Torino FC",
    "Tottenham": "Tottenham Hotspur FC",
    "Toulouse": "Toulouse FC",
    "Troyes": "ES Troyes AC",
    "Udinese": "Udinese Calcio",
    "Union Berlin": "1. FC Union Berlin",
    "Valencia": "Valencia CF",
    "Valladolid": "Real Valladolid CF",
    "Vallecano": "Rayo Vallecano de Madrid",
    "Venezia": "Venezia FC",
    "Verona": "Hellas Verona FC",
    "Villarreal": "Villarreal CF",
    "Watford": "Watford FC",
    "Werder Bremen": "SV Werder Bremen",
    "West Brom": "West Bromwich Albion FC",
    "West Ham": "West Ham United FC",
    "Wolfsburg": "VfL Wolfsburg",
    "Wolves": "Wolverhampton Wanderers FC",
}
