"""incognita: de-identification of medical-imaging headers as Spark jobs.

Subpackages:
  sources    -- tables, file scans, registry storage, test fixtures
  functions  -- pure Column expressions (tags, masks, text, numbering)
  operators  -- DataFrame -> DataFrame building blocks (screen, scrub, assign, ...)
  plans      -- end-to-end jobs and the registered query catalog
  streaming  -- incremental assignment over a drop folder
"""

__version__ = "0.1.0"
