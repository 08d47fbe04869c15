"""Vocabulary and rule tables of the data model. All values here are fixed."""

EXECUTORS = ["gripper", "suction", "hook", "dexterous_hand"]
TASKS = ["pick_up", "lift_carry", "open_pull", "press_push"]
ACTIVE_TASKS = ["pick_up", "open_pull", "press_push"]
SPLITS = ["train", "val", "test", "contrast_test"]
QUALITY_FLAGS = ["weak", "checked", "verified"]
SOURCE_DATASETS = ["3d_affordancenet", "partnet_mobility", "shapenet", "objaverse", "manual"]
LABEL_SOURCES = ["existing_affordance_mask", "part_annotation", "geometry_rule", "manual_refinement", "mixed", "unavailable"]
REQUIRED_FIELDS = [
    "object_id", "source_dataset", "object_category", "task", "task_instruction", "point_cloud_path", "multi_channel_mask_path",
    "executor_order", "feasibility", "label_source", "negative_reason", "quality_flag", "split",
]
STRING_FIELDS = ["object_id", "source_dataset", "object_category", "task", "task_instruction", "quality_flag", "split"]

# region-name keywords (fixed values)
HOOKABLE = ["hole", "inner", "ring", "loop", "gap", "hook", "hanger", "bail", "arch"]
HANDLE_LIKE = ["handle", "pull", "grasp", "hold", "knob", "lever", "stem", "neck"]
FLAT_LIKE = ["flat", "plane", "panel", "surface", "face", "top", "front", "lid", "plate_center"]
BODY_LIKE = ["body", "cup", "bottle", "cylinder", "shaft", "rim", "edge", "lip", "side"]
PRESS_LIKE = ["button", "switch", "key", "trigger", "press", "push", "pad"]
PULL_EDGE = ["edge", "recess"]
PULL_FLAT = ["panel", "front", "door", "drawer", "lid"]

# (task, executor, affordance, least ratio, most ratio) of weak labels (fixed values)
WEAK_LABEL_RULES = [
    *[(t, e, a, 0.0, 0.95) for t in ("pick_up", "lift_carry") for e in ("gripper", "dexterous_hand") for a in ("grasp", "wrap_grasp", "lift")],
    *[(t, "suction", a, 0.0, 0.95) for t in ("pick_up", "lift_carry") for a in ("support", "layable")],
    *[("open_pull", e, a, 0.0, 0.35) for e in ("gripper", "dexterous_hand") for a in ("pull", "openable")],
    *[("open_pull", "hook", a, 0.0, 0.15) for a in ("pull", "openable")],
    ("open_pull", "suction", "pushable", 0.0, 1.0),
    *[("open_pull", "suction", a, 0.30, 1.0) for a in ("pull", "openable")],
    ("press_push", "suction", "pushable", 0.0, 1.0),
    ("press_push", "dexterous_hand", "press", 0.0, 1.0),
    ("press_push", "dexterous_hand", "pushable", 0.0, 0.25),
]

# candidate families that the scoring rules name (fixed values)
HOOK_FAMILIES = [
    "thin_structure", "edge_or_boundary", "extreme_edge_or_lip", "protruding_or_thin_part", "small_protrusion",
    "visual_component_expanded", "expanded_loop_or_handle", "loop_or_hole_boundary", "paired_loop_or_handle",
    "expanded_functional_seed", "expanded_axis_part_component", "expanded_extreme_part_component", "expanded_existing_weak_mask",
    "visual_detached_structure", "visual_detached_component", "visual_small_component", "visual_component_seed",
    "loop_handle_lip_seed", "expanded_loop_handle_lip_seed", "strict_loop_handle_lip_seed", "expanded_strict_loop_handle_lip_seed",
    "small_part_seed", "expanded_small_part_seed", "paired_loop_handle_candidate",
]
SMOOTH_FAMILIES = [
    "smooth_surface", "smooth_extreme_patch", "central_body", "smooth_surface_component", "expanded_smooth_surface_component", "coarse_axis_partition",
]
PRESS_FAMILIES = [
    "small_protrusion", "small_part_seed", "expanded_small_part_seed", "smooth_surface", "smooth_extreme_patch",
    "smooth_surface_component", "expanded_smooth_surface_component",
]

# categories on which a task makes sense; tasks that are not named take any (fixed values)
TASK_CATEGORIES = {
    "open_pull": ["Door", "Dishwasher", "Faucet", "Laptop", "Microwave", "Refrigerator", "StorageFurniture", "TrashCan"],
    "press_push": ["Door", "Display", "Dishwasher", "Faucet", "Keyboard", "Laptop", "Microwave", "Refrigerator", "StorageFurniture"],
}

DECISIONS = ["keep", "refine", "add_missing", "disable", "not_applicable", "uncertain", ""]
REFINE_DECISIONS = ["refine", "add_missing", "uncertain"]
DISABLE_DECISIONS = ["disable", "not_applicable"]
ACCEPT_SCORE, UNCERTAIN_SCORE = 0.55, 0.25
