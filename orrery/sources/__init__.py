"""Where snapshots come from and go to."""

from .gadget import read_gadget, write_gadget
from .snapshots import chunks, from_arrays, read_snapshot, write_snapshot
from .views import PARTICLES_E_SQL, PARTICLES_L_SQL, STARS_EV_SQL, particles_e, particles_l, stars_ev

__all__ = ["PARTICLES_E_SQL", "PARTICLES_L_SQL", "STARS_EV_SQL", "chunks", "from_arrays", "particles_e", "particles_l", "read_gadget", "read_snapshot", "stars_ev", "write_gadget", "write_snapshot"]
