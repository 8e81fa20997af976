"""Fixed values of the drawing vocabulary: names, keywords, factors and rules, in the order in which they are tried."""

from __future__ import annotations

# Drawing unit codes -> metres; other codes count as metres.
UNIT_METRES = {0: 1.0, 1: 0.0254, 2: 0.3048, 4: 0.001, 5: 0.01, 6: 1.0, 7: 1000.0}
# Drawing unit codes -> square feet per squared unit; other codes take DEFAULT_SQFT.
UNIT_SQFT = {0: 10.7639, 1: 1.0 / 144.0, 2: 1.0, 4: 0.00001076391, 5: 0.001076391, 6: 10.7639}
DEFAULT_SQFT = 10.7639
# Fixed values, older engine: drawing unit codes -> feet; other codes count as feet.
UNIT_FEET = {0: 3.28084, 1: 1.0 / 12.0, 2: 1.0, 4: 0.00328084, 5: 0.0328084, 6: 3.28084}

# Words in layer names.
WALL_LAYER_HINTS = ("A-WALL", "WALL", "WALLS", "STRUCTURE", "STRUCT", "CORE", "ARCH", "OUTLINE", "PARTITION", "BEARING")
DOOR_LAYER_HINTS = ("A-DOOR", "DOOR", "DOORS", "DR")
NOISE_LAYERS = ("DIM", "DIMENSION", "GRID", "CONSTRUCTION", "HATCH", "FILL", "BOUNDARY", "TITLEBLOCK", "TITLE", "BORDER", "NORTH", "SCALE", "REVISION", "NOTES", "VIEWPORT", "DEFPOINTS")
GRAPH_WALL_HINTS = ("A-WALL", "WALL", "WALLS", "STRUCT", "CORE", "ARCH", "OUTLINE", "PARTITION", "BEARING")
GRAPH_NOISE = ("DIM", "DIMENSION", "GRID", "HATCH", "FILL", "ANNO", "TEXT", "FURN", "FURNITURE", "BORDER", "TITLE", "VIEWPORT", "DEFPOINT", "CONSTRUCTION")
WALL_LAYER_HINTS_V1 = ("WALL", "A-WALL", "STRUCT", "CORE", "ARCH", "OUTLINE")

# Words in block names.
DOOR_BLOCKS = ("DOOR", "DR", "SWING", "ENTRY", "GATE", "HINGED")
DOOR_BLOCKS_V1 = ("DOOR", "DR", "SWING", "ENTRY", "GATE")
FURNITURE = {
    "BED": "BED", "SOFA": "SOFA", "COUCH": "SOFA", "DINING": "DINING", "DINE": "DINING", "TABLE": "TABLE", "STOVE": "STOVE", "OVEN": "STOVE",
    "KITCHEN": "STOVE", "WC": "WC", "TOILET": "WC", "COMMODE": "WC", "SINK": "SINK", "BASIN": "SINK", "BATH": "BATH", "TUB": "BATH",
    "SHOWER": "SHOWER", "DESK": "DESK", "STUDY": "DESK", "WARDROBE": "WARDROBE", "ALMIRAH": "WARDROBE", "FRIDGE": "FRIDGE", "REFRIG": "FRIDGE", "WASH": "WASHER",
}
FURNITURE_V1 = {"BED": "BED", "SOFA": "SOFA", "DINING": "DINING", "DINE": "DINING", "STOVE": "STOVE", "WC": "WC", "TOILET": "WC", "SINK": "SINK"}
# Block keyword -> room it suggests, and confidence.
BLOCK_HINTS = {
    "BED": ("Bedroom", 0.9), "SOFA": ("Living Room", 0.7), "COUCH": ("Living Room", 0.7), "DINING": ("Dining Room", 0.85), "DINE": ("Dining Room", 0.8),
    "TABLE": ("Dining Room", 0.4), "STOVE": ("Kitchen", 0.95), "OVEN": ("Kitchen", 0.9), "KITCHEN": ("Kitchen", 0.95), "WC": ("Toilet", 0.95),
    "TOILET": ("Toilet", 0.95), "COMMODE": ("Toilet", 0.9), "SINK": ("Bathroom", 0.6), "BASIN": ("Bathroom", 0.6), "BATH": ("Bathroom", 0.85),
    "TUB": ("Bathroom", 0.85), "SHOWER": ("Bathroom", 0.8), "DESK": ("Study Room", 0.8), "STUDY": ("Study Room", 0.75), "WARDROBE": ("Bedroom", 0.6),
    "ALMIRAH": ("Bedroom", 0.6), "FRIDGE": ("Kitchen", 0.7), "REFRIG": ("Kitchen", 0.7), "WASH": ("Utility", 0.6), "LAUNDRY": ("Utility", 0.65),
}

# The room types.
ROOM_TYPES = ("Bedroom", "Kitchen", "Hall", "Living Room", "Toilet", "Bathroom", "Utility", "Corridor", "Balcony", "Staircase", "Dining Room", "Study Room", "Pooja Room", "Store Room", "Open Area")
# Square feet below which a room has this type, and the confidence.
AREA_RULES = ((15.0, "Utility", 0.80), (35.0, "Toilet", 0.82), (65.0, "Toilet", 0.72), (130.0, "Bedroom", 0.70), (220.0, "Bedroom", 0.65), (400.0, "Hall", 0.68))
OPEN_AREA = ("Open Area", 0.60)
AREA_RULES_V1 = ((25.0, "Utility"), (45.0, "Toilet"), (80.0, "Kitchen"), (160.0, "Bedroom"), (300.0, "Hall"))
# Room type -> types that are common next to it.
NEXT_TO = {
    "Bedroom": ("Hall", "Toilet", "Bathroom", "Study Room"),
    "Kitchen": ("Dining Room", "Hall", "Utility"),
    "Toilet": ("Bedroom", "Bathroom", "Hall"),
    "Bathroom": ("Bedroom", "Toilet", "Hall"),
    "Hall": ("Bedroom", "Kitchen", "Dining Room", "Living Room", "Toilet", "Bathroom", "Balcony", "Staircase"),
    "Living Room": ("Hall", "Dining Room", "Balcony", "Study Room"),
    "Dining Room": ("Kitchen", "Hall", "Living Room"),
    "Study Room": ("Bedroom", "Hall"),
    "Utility": ("Kitchen", "Bathroom"),
    "Balcony": ("Bedroom", "Living Room", "Hall"),
    "Staircase": ("Hall", "Corridor"),
    "Pooja Room": ("Hall",),
    "Store Room": ("Kitchen", "Utility"),
}
# Weights of the geometry, block, neighbour and vision signals; confidence under which vision is asked.
WEIGHTS = (0.35, 0.35, 0.20, 0.10)
ASK_VISION_BELOW = 0.75

# Label texts -> room types, current engine.
LABELS = {
    "BED": "Bedroom", "BEDROOM": "Bedroom", "BED ROOM": "Bedroom", "MASTER BED": "Bedroom", "MASTER BEDROOM": "Bedroom", "GUEST ROOM": "Bedroom",
    "KIT": "Kitchen", "KITCHEN": "Kitchen", "KITCHENETTE": "Kitchen",
    "HALL": "Hall", "LOBBY": "Hall", "FOYER": "Hall", "LOUNGE": "Living Room", "DRAWING": "Living Room", "DRAWING ROOM": "Living Room",
    "LIVING": "Living Room", "LIVING ROOM": "Living Room", "LIV": "Living Room", "FAMILY": "Living Room", "FAMILY ROOM": "Living Room",
    "DINING": "Dining Room", "DINING ROOM": "Dining Room", "DINE": "Dining Room",
    "TOILET": "Toilet", "WC": "Toilet", "WASHROOM": "Toilet", "WATER CLOSET": "Toilet", "LAVATORY": "Toilet",
    "BATH": "Bathroom", "BATHROOM": "Bathroom", "BATH ROOM": "Bathroom", "ENSUITE": "Bathroom",
    "UTILITY": "Utility", "UTIL": "Utility", "LAUNDRY": "Utility", "STORE": "Store Room", "STORE ROOM": "Store Room", "STORAGE": "Store Room", "PANTRY": "Store Room",
    "BALC": "Balcony", "BALCONY": "Balcony", "TERRACE": "Balcony", "VERANDAH": "Balcony",
    "CORRIDOR": "Corridor", "PASSAGE": "Corridor", "PASSAGEWAY": "Corridor", "GALLERY": "Corridor",
    "STAIR": "Staircase", "STAIRCASE": "Staircase", "STAIRWAY": "Staircase",
    "POOJA": "Pooja Room", "PRAYER": "Pooja Room", "PUJA": "Pooja Room", "STUDY": "Study Room", "OFFICE": "Study Room",
    "OPEN": "Open Area", "COURTYARD": "Open Area", "ATRIUM": "Open Area",
}
# Recognised words -> room types, text recognition.
OCR_LABELS = {
    "BED ROOM": "Bedroom", "BEDROOM": "Bedroom", "KITCHEN": "Kitchen", "LIVING": "Hall", "LIVING ROOM": "Living Room", "HALL": "Hall",
    "DINING": "Dining Room", "DINING ROOM": "Dining Room", "TOILET": "Toilet", "WC": "Toilet", "BATH": "Bathroom", "BATHROOM": "Bathroom",
    "UTILITY": "Utility", "STORE": "Store Room", "STORE ROOM": "Store Room", "STUDY": "Study Room", "POOJA": "Pooja Room", "BALCONY": "Balcony",
    "CORRIDOR": "Corridor", "PASSAGE": "Corridor",
}
# Abbreviations -> names, bulk normaliser.
SHORT_LABELS = {
    "BED RM": "Bedroom", "BED ROOM": "Bedroom", "BEDROOM": "Bedroom", "BR": "Bedroom", "M.BED": "Master Bedroom", "MASTER BED": "Master Bedroom",
    "MASTER BEDROOM": "Master Bedroom", "KIT": "Kitchen", "KITCHEN": "Kitchen", "KTCHN": "Kitchen", "LIV": "Living Room", "LIVING": "Living Room",
    "LIVING ROOM": "Living Room", "HALL": "Hall", "DRAWING": "Drawing Room", "DRAWING ROOM": "Drawing Room", "DINING": "Dining Room",
    "DINING ROOM": "Dining Room", "TOILET": "Toilet", "WC": "Toilet", "W.C.": "Toilet", "BATH": "Bathroom", "BATHROOM": "Bathroom", "BATH ROOM": "Bathroom",
    "BALCONY": "Balcony", "BAL": "Balcony", "POOJA": "Pooja Room", "PUJA": "Pooja Room", "STORE": "Store Room", "STORE ROOM": "Store Room",
    "UTILITY": "Utility", "UTILITY ROOM": "Utility", "LOBBY": "Lobby", "PASSAGE": "Passage", "CORRIDOR": "Corridor", "STAIRCASE": "Staircase",
    "STAIRS": "Staircase", "FOYER": "Foyer", "ENTRANCE": "Entrance", "GARAGE": "Garage", "CAR PARK": "Parking", "PARKING": "Parking", "WASH": "Wash Area",
    "WASH AREA": "Wash Area", "LAUNDRY": "Laundry", "STUDY": "Study Room", "STUDY ROOM": "Study Room", "GUEST": "Guest Room", "GUEST ROOM": "Guest Room",
    "SIT OUT": "Sit Out", "SITOUT": "Sit Out",
}
# Place on a 3 x 3 grid -> share of the width and height; others lie in the centre.
GRID_PLACES = {
    "top-left": (0.0, 1.0), "top-center": (0.5, 1.0), "top-right": (1.0, 1.0), "center-left": (0.0, 0.5), "center": (0.5, 0.5), "center-right": (1.0, 0.5),
    "bottom-left": (0.0, 0.0), "bottom-center": (0.5, 0.0), "bottom-right": (1.0, 0.0),
}
# Signs of an exhausted quota in an error message.
QUOTA_SIGNS = ("429", "quota", "rate_limit", "rate limit", "resource_exhausted", "RESOURCE_EXHAUSTED", "NOT_FOUND")
