"""Part of quillstone: plans."""
