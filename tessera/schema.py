"""Table schemas (X23). A reader that is given one needs no inference."""

POINT = "struct<x:double,y:double>"
POINTS = f"array<{POINT}>"
LAYOUT = f"struct<pattern:string,angle_deg:double,origin:{POINT}>"
PROJECT = "project_id bigint, name string, unit_system string, scale double, tax_rate double, labor_rate_per_sf double"
ROOM = f"project_id bigint, room_id bigint, room_ord int, name string, points {POINTS}, wall_height double, pattern string"
MATERIAL = """material_id bigint, name string, type string, tw double, th double, grout double, pattern string, waste double,
price double, price_unit string, sf_per_box double, face_coverage double, cost_mode string, optimize_whole_job boolean,
cut_safety_pct double, grain_locked boolean"""
BRIDGE = "project_id bigint, room_id bigint, material_id bigint"
#: What the tables of documents have besides: a material's project, place and colour, and an assignment's place.
PROJECT_MATERIAL = f"project_id bigint, material_ord int, color string, {MATERIAL}"
ORDERED_BRIDGE = f"{BRIDGE}, pos int"
MARKUP = f"project_id bigint, markup_id bigint, type string, points {POINTS}, name string, note string, unit_cost double"
#: A stored project: the document as JSON beside the columns that lists and reports read.
STORED = "project_id bigint, owner bigint, name string, unit_system string, doc string, floor_sf double, total_cost double, archived boolean, created_at timestamp, updated_at timestamp"
TILE_LIBRARY = "tile_id bigint, owner bigint, name string, tw_in double, th_in double, thickness_mm double, material string, finish string, sku string, vendor string, price double, price_unit string, sf_per_box double, created_at timestamp"
#: The JSON form of a project document. Ids are text; a room's pattern, angle and origin are its layout.
DOCUMENT = f"""struct<schema:string,name:string,unitSystem:string,scale:double,archScale:string,
rooms:array<struct<id:string,name:string,color:string,points:{POINTS},assigned:array<string>,wallHeight:double,pattern:string,layout:struct<pattern:string,angleDeg:double,origin:{POINT}>>>,
materials:array<struct<id:string,name:string,color:string,type:string,tw:double,th:double,grout:double,pattern:string,waste:double,price:double,priceUnit:string,sfPerBox:double,faceCoverage:double,costMode:string,optimizeWholeJob:boolean,cutSafetyPct:double,grainLocked:boolean>>,
markups:array<struct<id:string,type:string,points:{POINTS},name:string,note:string,color:string,unitCost:double>>,
taxRate:double,laborRatePerSf:double,showGrid:boolean,planImage:string>""".replace("\n", "")
#: What a new project starts from.
DEFAULTS = {"name": "Untitled Takeoff", "unit_system": "imperial_ft_in", "tax_rate": 8.625, "labor_rate_per_sf": 0.0, "show_grid": True}
