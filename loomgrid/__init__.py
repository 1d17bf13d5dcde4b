"""loomgrid: quality control and forecast evaluation of hourly entity panels on Spark."""
