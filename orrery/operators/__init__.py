"""Filters, transforms, properties, profiles and gravity."""

from .bins import BinsSet, Edges, available_options, bins_algorithm_register, bins_area_register, bins_by_register
from .expr import AggregateProperty, Constant, Lambda, Property, as_property
from .filters import Annulus, BandPass, Cuboid, Disc, FamilyFilter, Filter, HighPass, LowPass, SolarNeighborhood, Sphere, VolumeFilter, Where
from .gravity import Gravity, calculate_acceleration, calculate_potential
from .partials import Folded, Partial, histogram, partial_statistic
from .profiles import Profile, ProfileBuilder, RadialProfile, RadialProfileBuilder, StarAgeProfile, profile_property, statistic
from .properties import AngMomVec, CenPos, CenVel, Count, KappaRot, KappaRotMean, ParamContain, ParamSum, PatternSpeed, RadiusAtSurfaceDensity, SpinParam, SurfaceDensity, VirialRadius, VolumeDensity
from .transforms import AlignAngMomVec, AlignVec, Chain, Rotate, ShiftPosTo, ShiftVelTo, Transform, WrapBox, chain

__all__ = [
    "AggregateProperty", "AlignAngMomVec", "AlignVec", "AngMomVec", "Annulus", "BandPass", "BinsSet", "CenPos", "CenVel", "Chain", "Constant", "Count", "Cuboid", "Disc", "Edges", "FamilyFilter", "Filter", "Folded", "Gravity",
    "HighPass", "KappaRot", "KappaRotMean", "Lambda", "LowPass", "ParamContain", "ParamSum", "Partial", "PatternSpeed", "Profile", "ProfileBuilder", "Property", "RadialProfile", "RadialProfileBuilder", "RadiusAtSurfaceDensity", "Rotate",
    "ShiftPosTo", "ShiftVelTo", "SolarNeighborhood", "SpinParam", "Sphere", "StarAgeProfile", "SurfaceDensity", "Transform", "VirialRadius", "VolumeDensity", "VolumeFilter", "Where", "WrapBox", "as_property", "available_options",
    "bins_algorithm_register", "bins_area_register", "bins_by_register", "calculate_acceleration", "calculate_potential", "chain", "histogram", "partial_statistic", "profile_property", "statistic",
]
