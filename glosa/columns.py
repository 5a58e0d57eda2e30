"""Column names of the comment data model."""

COMMENT_ID = "comment_id"
TEXT = "c_text"
FOLD = "fold"

# Label columns, in task order, and the task names used in metric tables.
LABELS = ["Sub1_Toxic", "Sub2_Engaging", "Sub3_FactClaiming"]
TASKS = ["Toxic", "Engaging", "FactClaiming"]
