"""Where pages come from: text tables as blocks, files of pages, fixtures."""
