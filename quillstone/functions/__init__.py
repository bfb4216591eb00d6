"""Part of quillstone: functions."""
